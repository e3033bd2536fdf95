"""engramix: a PySpark-native analytics engine for agent and conversation memory."""

__version__ = "0.1.0"

"""Operators for building training data from text and vectors."""

#: Modules of this subpackage with QUERIES and SQL.
PLANS = ("plan_pii", "plan_ranking", "plan_names", "plan_pieces", "plan_conversations", "plan_neighbours", "plan_containers", "plan_leaks", "plan_sentences")

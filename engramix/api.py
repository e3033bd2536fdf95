"""Handles for programs: an engine over a folder of tables, with recall, rules and hypotheses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramix.operators import derive, mutate
from engramix.operators.predicates import Viewer, allowed, read_only
from engramix.operators.recall import Settings, recall
from engramix.session import get_spark


class Engine:
    """Tables by name; every change replaces a table by another one, and nothing is written until ``save``."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or get_spark()
        self.tables: dict[str, DataFrame] = {}
        self.rules: dict[str, str] = {}
        self.hooks: dict[str, Callable] = {}

    @classmethod
    def open(cls, folder: str, names: list[str], spark: SparkSession | None = None) -> "Engine":
        engine = cls(spark)
        for name in names:
            engine.tables[name] = engine.spark.read.parquet(f"{folder}/{name}.parquet")
        return engine

    def save(self, folder: str, mode: str = "overwrite") -> None:
        for name, df in self.tables.items():
            df.write.mode(mode).parquet(f"{folder}/{name}.parquet")

    def _views(self, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    def query(self, sql: str, allow: DataFrame | None = None, **args) -> DataFrame:
        """A read-only statement over the tables; ``allow`` (nid) is the view allow and restricts every table that has a nid."""
        if not read_only(sql):
            raise ValueError("only reading statements are allowed")
        tables = dict(self.tables)
        if allow is not None:
            tables = {n: allowed(df, allow) if "nid" in df.columns else df for n, df in tables.items()} | {"allow": allow}
        self._views(tables)
        return self.spark.sql(sql, args=args or None)

    # Rules are named statements with parameters.
    def define_rule(self, name: str, sql: str) -> None:
        if not read_only(sql):
            raise ValueError("a rule only reads")
        self.rules[name] = sql

    def run_rule(self, name: str, columns: list[str] | None = None, **args) -> DataFrame:
        found = self.query(self.rules[name], **args)
        return found.select(*columns) if columns else found

    def delete_rule(self, name: str) -> bool:
        return self.rules.pop(name, None) is not None

    def explain_rule(self, name: str, **args) -> str:
        return self.run_rule(name, **args)._jdf.queryExecution().toString()

    def assume(self, adds: dict[str, DataFrame] | None = None, drops: dict[str, tuple[str, DataFrame]] | None = None) -> "Engine":
        """An engine in which rows are added and others (key column, keys) are missing; this one stays as it is."""
        other = Engine(self.spark)
        other.rules, other.hooks = dict(self.rules), dict(self.hooks)
        other.tables = dict(self.tables)
        for name, (key, keys) in (drops or {}).items():
            other.tables[name] = other.tables[name].join(keys.select(key).distinct(), key, "left_anti")
        for name, rows in (adds or {}).items():
            other.tables[name] = other.tables[name].unionByName(rows, allowMissingColumns=True)
        return other

    def abduce(self, rule: str, candidates: list[tuple[str, float, "Engine"]], **args) -> list[tuple[str, float, int]]:
        """(name, cost, rows) of the hypothetical engines under which the rule gives rows, cheapest first."""
        tried = [(name, cost, engine.run_rule(rule, **args).count()) for name, cost, engine in candidates]
        return sorted((t for t in tried if t[2]), key=lambda t: (t[1], t[0]))

    def recall(self, questions: DataFrame, settings: Settings = Settings(), viewer: Viewer | None = None, allow: DataFrame | None = None) -> DataFrame:
        return recall(self.tables["items"], questions, settings, allow, viewer)

    def answer(self, questions: DataFrame, generate: Callable[[str, str], str], **options) -> list[tuple[object, str]]:
        """(query_id, answer) by a callback that gets question and context; questions are few, so their contexts are fetched."""
        found = self.recall(questions, **options)
        contexts = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: x["content"]), "\n").alias("context"))
        rows = questions.join(contexts, "query_id", "left").select("query_id", "query", F.coalesce("context", F.lit("")).alias("context"))
        return [(r["query_id"], generate(r["query"], r["context"])) for r in rows.toLocalIterator()]

    def consolidate(self) -> DataFrame:
        """Facts of the table observations, laid over the table facts."""
        voted = derive.votes(self.tables["observations"])
        fresh = derive.facts(derive.canonical_objects(voted))
        if "facts" in self.tables:
            base = self.tables["facts"].select("fact_id", "subject", "predicate", "object", "observation_count", "first_observed")
            self.tables["facts"] = mutate.upsert_facts(base, fresh)
        else:
            self.tables["facts"] = fresh
        return self.tables["facts"]

    def forget(self, table: str, key: str, keys: DataFrame) -> None:
        """Rows with these keys are gone, and the edges at either end of them."""
        if "edges" in self.tables and key == "nid":
            self.tables[table], self.tables["edges"] = mutate.delete(self.tables[table], self.tables["edges"], keys)
        else:
            self.tables[table] = self.tables[table].join(keys.select(key).distinct(), key, "left_anti")

"""Predicate trees, scopes and visibility as Column expressions."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def predicate(tree: tuple) -> Column:
    """('eq', column, value), ..., ('in', column, values), ('is_null', column), ('and'|'or', *trees) or ('not', tree).

    Empty 'and' and 'or' are true; a comparison with null is unknown, so the row is dropped.
    """
    kind, *args = tree
    if kind in _COMPARE:
        return _COMPARE[kind](F.col(args[0]), F.lit(args[1]))
    if kind == "in":
        return F.col(args[0]).isin(*args[1]) if args[1] else F.lit(False)
    if kind in ("is_null", "is_not_null"):
        return F.col(args[0]).isNull() if kind == "is_null" else F.col(args[0]).isNotNull()
    if kind == "not":
        return ~predicate(args[0])
    if kind in ("and", "or"):
        return reduce(operator.and_ if kind == "and" else operator.or_, map(predicate, args)) if args else F.lit(True)
    raise ValueError(f"unknown predicate: {kind}")


@dataclass
class Scope:
    """What a query may see; a dimension that is None doesn't restrict."""

    sessions: list[str] | None = None
    participants: list[str] | None = None
    since: object = None
    until: object = None
    categories: list[str] | None = None
    sources: list[str] | None = None
    include_retired: bool = False

    def unconstrained(self) -> bool:
        return all(v is None for v in (self.sessions, self.participants, self.since, self.until, self.categories, self.sources))


def in_scope(scope: Scope, session: str = "session_id", participant: str = "sender_id", at: str = "msg_timestamp", category: str = "category", source: str = "source_id") -> Column:
    """Rows of a scope: listed values, and the half-open time window [since, until)."""
    tests = [F.col(c).isin(*v) if v else F.lit(False) for c, v in ((session, scope.sessions), (participant, scope.participants), (category, scope.categories), (source, scope.sources)) if v is not None]
    if scope.since is not None:
        tests.append(F.col(at) >= F.lit(scope.since))
    if scope.until is not None:
        tests.append(F.col(at) < F.lit(scope.until))
    return reduce(operator.and_, tests) if tests else F.lit(True)


@dataclass
class Viewer:
    participant: str
    teams: list[str] = field(default_factory=list)
    organizations: list[str] = field(default_factory=list)


def admits(visibility: Column, viewer: Viewer) -> Column:
    """Null, blank and public for all; private, team and org for their members; anything else for nobody."""
    v = F.trim(F.coalesce(visibility, F.lit("")))
    rest = F.substring_index(v, ":", -1)
    member = lambda ids: rest.isin(*ids) if ids else F.lit(False)
    return F.when((v == "") | (v == "public"), True).when(v.startswith("private:"), rest == viewer.participant).when(v.startswith("team:"), member(viewer.teams)).when(v.startswith("org:"), member(viewer.organizations)).otherwise(False)


def excluded(rows: DataFrame, exclusions: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without those whose keys are excluded; null keys are never excluded."""
    return rows.join(exclusions.select(*keys).distinct(), keys, "left_anti")


def allowed(rows: DataFrame, allow: DataFrame | None, key: str = "nid") -> DataFrame:
    """None means no restriction, an empty table nothing."""
    return rows if allow is None else rows.join(allow.select(key).distinct(), key, "left_semi")


#: Statements that change data.
WRITES = r"(?i)\b(create|merge|delete|detach|set|remove|drop|load|insert|update|truncate|alter)\b"


def read_only(sql: str) -> bool:
    """Whether a statement only reads: no writing word outside quotes."""
    import re

    return not re.search(WRITES, re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`", " ", sql))

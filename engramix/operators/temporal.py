"""Intervals, chains, as-of joins, decay and relative time phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from engramix.schema import LONG_MAX

DAY_MS = 86_400_000


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def open_interval(at: Column) -> Column:
    """[at, infinity), by day, approximate."""
    return F.struct(millis(at).alias("lo"), F.lit(LONG_MAX).alias("hi"), F.lit("day").alias("lo_granularity"), F.lit("day").alias("hi_granularity"), F.lit("approximate").alias("lo_certainty"), F.lit("approximate").alias("hi_certainty"))


def closed(interval: Column, now_ms: Column) -> Column:
    return interval.withField("hi", now_ms).withField("hi_certainty", F.lit("definite"))


def upgraded(interval: Column, count: Column, least: int = 10) -> Column:
    """Certainty of the begin becomes definite once ``count`` reaches ``least``."""
    return F.when(count >= least, interval.withField("lo_certainty", F.lit("definite"))).otherwise(interval)


def contains(interval: Column, point_ms: Column) -> Column:
    return (interval["lo"] <= point_ms) & (point_ms < interval["hi"])


def overlaps(a: Column, b: Column) -> Column:
    return (a["lo"] < b["hi"]) & (b["lo"] < a["hi"])


def before(a: Column, b: Column) -> Column:
    return a["hi"] <= b["lo"]


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket_ms: int = 30 * DAY_MS) -> DataFrame:
    """Pairs of rows with equal ``keys`` and overlapping half-open intervals lo, hi (milliseconds).

    Finite intervals are spread over time buckets and joined on key and bucket; a pair counts only in
    the bucket of its later begin, so it comes once. Intervals with an open end overlap all that end after their begin, and
    are joined for themselves, so none is spread up to a horizon. ``right`` columns, keys apart, get the suffix _r.
    """
    r = right.select(*[F.col(c) if c in keys else F.col(c).alias(f"{c}_r") for c in right.columns]).where("lo_r < hi_r")
    a = left.where("lo < hi")
    spread = lambda df, lo, hi: df.where(F.col(hi) < LONG_MAX).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(lo) / bucket_ms), F.floor((F.col(hi) - 1) / bucket_ms))))
    once = F.col("__bucket") == F.floor(F.greatest("lo", "lo_r") / bucket_ms)
    finite = spread(a, "lo", "hi").join(spread(r, "lo_r", "hi_r"), [*keys, "__bucket"]).where((F.col("lo") < F.col("hi_r")) & (F.col("lo_r") < F.col("hi")) & once).drop("__bucket")
    open_left = a.where(F.col("hi") == LONG_MAX).join(r, keys).where("hi_r > lo")
    open_right = a.where(F.col("hi") < LONG_MAX).join(r.where(F.col("hi_r") == LONG_MAX), keys).where("hi > lo_r")
    return finite.unionByName(open_left).unionByName(open_right)


def with_previous(rows: DataFrame, per: list[str], ts: str, tie: str) -> DataFrame:
    """``rows`` with ``__prev``, struct (at, tie) of the row before in its group by (ts, tie), null for the first; null times come first.

    Rows are sorted within days; the first of a day gets the last of the days before, of which there is one row each, so a group
    that holds a third of all rows is spread over its days.
    """
    dated = rows.withColumn("__day", F.to_date(ts)).withColumn("__me", F.struct(F.col(ts).alias("at"), F.col(tie).alias("tie")))
    order = W.partitionBy(*per).orderBy(F.col("__day").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    days = dated.groupBy(*per, "__day").agg(F.max("__me").alias("__last")).withColumn("__before", F.last("__last").over(order)).drop("__last")
    renamed = days.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(per)], F.col("__day").alias("__d"), "__before")
    on = F.col("__day").eqNullSafe(F.col("__d"))
    for i, c in enumerate(per):
        on = on & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    within = W.partitionBy(*per, "__day").orderBy(F.col(ts).asc_nulls_first(), tie)
    return dated.withColumn("__lag", F.lag("__me").over(within)).join(renamed, on).select(*rows.columns, F.coalesce("__lag", "__before").alias("__prev"))


def chain(rows: DataFrame, per: list[str], ts: str, tie: str, max_gap_ms: int | None = None) -> DataFrame:
    """(per, src, dst, gap_ms): each row with the one before it; gaps are at least 0, longer ones than ``max_gap_ms`` break the chain."""
    linked = with_previous(rows, per, ts, tie).where("__prev is not null")
    gap = F.greatest(F.lit(0), millis(F.col(ts)) - millis(F.col("__prev.at")))
    linked = linked.select(*per, F.col("__prev.tie").alias("src"), F.col(tie).alias("dst"), gap.alias("gap_ms"))
    return linked if max_gap_ms is None else linked.where(F.col("gap_ms") <= max_gap_ms)


def positions(rows: DataFrame, per: list[str], ts: str, tie: str) -> DataFrame:
    """``rows`` with ``position``, from 1 in each group in order of (ts, tie), null times last.

    Days are numbered for themselves and get the count of the days before them, so a group that holds a third of all rows is spread over its days.
    """
    dated = rows.withColumn("__late", F.col(ts).isNull()).withColumn("__day", F.to_date(ts))
    before = W.partitionBy(*per).orderBy("__late", "__day").rowsBetween(W.unboundedPreceding, -1)
    days = dated.groupBy(*per, "__late", "__day").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    renamed = days.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(per)], F.col("__late").alias("__l"), F.col("__day").alias("__d"), "__before")
    on = (F.col("__late") == F.col("__l")) & F.col("__day").eqNullSafe(F.col("__d"))
    for i, c in enumerate(per):
        on = on & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    within = F.row_number().over(W.partitionBy(*per, "__late", "__day").orderBy(ts, tie))
    placed = dated.withColumn("__within", within).join(renamed, on)
    return placed.select(*rows.columns, (F.col("__before") + F.col("__within")).cast("int").alias("position"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str, tolerance_ms: int | None = None) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before its time, within the tolerance, else null.

    Both sides are stacked and scanned in order of time; no pairs are formed. Days of a key are scanned for themselves and get the last value of
    the days before, of which there is one row each, so a hot key is spread over its days.
    """
    a = left.withColumn("__t", F.col(left_ts)).withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__vt", F.lit(None).cast(left.schema[left_ts].dataType))
    b = right.select(*keys, F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.col(right_ts).alias("__vt"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__day", F.to_date("__t")).withColumn("__held", F.when(F.col("__side") == 0, F.struct("__vt", "__v")))
    before = W.partitionBy(*keys).orderBy("__day").rowsBetween(W.unboundedPreceding, -1)
    days = both.groupBy(*keys, "__day").agg(F.max("__held").alias("__last")).withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).drop("__last")
    renamed = days.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col("__day").alias("__d"), "__carried")
    on = F.col("__day").eqNullSafe(F.col("__d"))
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    w = W.partitionBy(*keys, "__day").orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = both.withColumn("__own", F.last("__held", ignorenulls=True).over(w)).where("__side = 1").join(renamed, on)
    last = F.coalesce("__own", "__carried")
    near = F.lit(True) if tolerance_ms is None else (millis(F.col("__t")) - millis(last["__vt"])) <= tolerance_ms
    return seen.withColumn(f"{value}_asof", F.when(near, last["__v"])).select(*left.columns, f"{value}_asof")


def decayed(importance: Column, at: Column, now: Column, half_life_days: float) -> Column:
    """importance * exp(-ln 2 / half-life * whole days)."""
    days = F.floor((millis(now) - millis(at)) / DAY_MS)
    return F.coalesce(importance, F.lit(0.5)) * F.exp(-F.ln(F.lit(2.0)) / half_life_days * days)


def rolling_count(rows: DataFrame, per: list[str], ts: str, days: int) -> DataFrame:
    """``rows`` with ``recent``: rows of the same group in the ``days`` before it, itself included."""
    w = W.partitionBy(*per).orderBy(millis(F.col(ts))).rangeBetween(-days * DAY_MS, 0)
    return rows.withColumn("recent", F.count("*").over(w))


def sessions_by_gap(rows: DataFrame, per: list[str], ts: str, tie: str, gap_ms: int) -> DataFrame:
    """``rows`` with ``part``, one more after each gap above ``gap_ms``; parts are counted within days, and those of the days before added."""
    marked = with_previous(rows, per, ts, tie)
    marked = marked.withColumn("__opens", F.when(millis(F.col(ts)) - millis(F.col("__prev.at")) > gap_ms, 1).otherwise(0)).withColumn("__day", F.to_date(ts))
    before = W.partitionBy(*per).orderBy(F.col("__day").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    days = marked.groupBy(*per, "__day").agg(F.sum("__opens").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    renamed = days.select(*[F.col(c).alias(f"__q{i}") for i, c in enumerate(per)], F.col("__day").alias("__d"), "__base")
    on = F.col("__day").eqNullSafe(F.col("__d"))
    for i, c in enumerate(per):
        on = on & F.col(c).eqNullSafe(F.col(f"__q{i}"))
    upto = F.sum("__opens").over(W.partitionBy(*per, "__day").orderBy(F.col(ts).asc_nulls_first(), tie))
    return marked.withColumn("__upto", upto).join(renamed, on).select(*rows.columns, (F.col("__base") + F.col("__upto") + 1).alias("part"))


# Numbers in words, days of the week and months.
NUMBERS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten".split(), 1)}
WEEKDAYS = {"monday": 0, "mon": 0, "tuesday": 1, "tue": 1, "tues": 1, "wednesday": 2, "wed": 2, "thursday": 3, "thu": 3, "thur": 3, "thurs": 3, "friday": 4, "fri": 4, "saturday": 5, "sat": 5, "sunday": 6, "sun": 6}
MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
MONTHS |= {m[:3]: i for m, i in list(MONTHS.items())}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def resolve_phrase(text: Column, reference: Column) -> Column:
    """struct(point, granularity) of the first time phrase in ``text``, relative to ``reference``; null without one.

    Order: yesterday, tomorrow, today; weekends; 'N days ago' and 'in N days' (a month counts 30 days, a
    year 365); a weekday with last (also meant without a word), this or next, unless joined by a hyphen; last or next week,
    month and year; 'in May', the nearest one past, the current month being that of last year.
    """
    low = F.lower(text)
    count_re, unit_re = r"(\d+|one|two|three|four|five|six|seven|eight|nine|ten)", r"(day|weekend|week|month|year)s?"
    day = lambda n: F.make_dt_interval(n)

    def number(match: Column) -> Column:
        return F.coalesce(F.try_element_at(_map(NUMBERS), match), match.try_cast("int")) if hasattr(match, "try_cast") else F.coalesce(F.try_element_at(_map(NUMBERS), match), match.cast("int"))

    ago, ahead = rf"\b{count_re}\s+{unit_re}\s+ago\b", rf"\bin\s+{count_re}\s+{unit_re}\b"
    length = _map({"day": 1, "weekend": 7, "week": 7, "month": 30, "year": 365})
    span = lambda pattern: number(F.regexp_extract(low, pattern, 1)) * F.try_element_at(length, F.regexp_extract(low, pattern, 2))
    unit = lambda pattern: F.replace(F.regexp_extract(low, pattern, 2), F.lit("weekend"), F.lit("week"))
    names = "|".join(sorted(WEEKDAYS, key=len, reverse=True))
    week_re = rf"(?:(last|this|next)\s+)?(?<!-)\b({names})\b(?!-)"
    prefix, target = F.regexp_extract(low, week_re, 1), F.try_element_at(_map(WEEKDAYS), F.regexp_extract(low, week_re, 2))
    back = F.pmod(F.weekday(reference) - target, F.lit(7))
    delta = F.when(prefix == "next", F.when(back == 0, 7).otherwise(7 - back)).when(prefix == "this", target - F.weekday(reference)).otherwise(F.when(back == 0, -7).otherwise(-back))
    month = F.try_element_at(_map(MONTHS), F.regexp_extract(low, rf"\bin\s+({'|'.join(sorted(MONTHS, key=len, reverse=True))})\b", 1))
    past_month = F.make_date(F.year(reference) - F.when(F.month(reference) > month, 0).otherwise(1), month, F.lit(1)).cast("timestamp_ntz") + (reference - F.date_trunc("DAY", reference).cast("timestamp_ntz"))
    out = lambda point, grain: F.struct(point.cast("timestamp_ntz").alias("point"), (F.lit(grain) if isinstance(grain, str) else grain).alias("granularity"))
    return (
        F.when(low.contains("yesterday"), out(reference - day(F.lit(1)), "day")).when(low.contains("tomorrow"), out(reference + day(F.lit(1)), "day")).when(low.rlike(r"\btoday\b"), out(reference, "day"))
        .when(low.contains("last weekend"), out(reference - day(F.lit(7)), "week")).when(low.contains("this weekend"), out(reference, "week")).when(low.contains("next weekend"), out(reference + day(F.lit(7)), "week"))
        .when(low.rlike(ago), out(reference - day(span(ago)), unit(ago))).when(low.rlike(ahead), out(reference + day(span(ahead)), unit(ahead)))
        .when(low.rlike(week_re), out(reference + day(delta), "day"))
        .when(low.contains("last week"), out(reference - day(F.lit(7)), "week")).when(low.contains("last month"), out(reference - day(F.lit(30)), "month")).when(low.contains("last year"), out(reference - F.make_ym_interval(F.lit(1)), "year"))
        .when(low.contains("next week"), out(reference + day(F.lit(7)), "week")).when(low.contains("next month"), out(reference + day(F.lit(30)), "month")).when(low.contains("next year"), out(reference + F.make_ym_interval(F.lit(1)), "year"))
        .when(month.isNotNull(), out(past_month, "month"))
    )


def phrase_window(point: Column, granularity: Column) -> tuple[Column, Column]:
    """Half-open range of a resolved phrase: its day, the seven days from it, its month or its year."""
    day0 = F.date_trunc("DAY", point)
    lo = F.when(granularity == "month", F.date_trunc("MONTH", point)).when(granularity == "year", F.date_trunc("YEAR", point)).when(granularity == "week", point).otherwise(day0)
    hi = F.when(granularity == "month", lo + F.make_ym_interval(F.lit(0), F.lit(1))).when(granularity == "year", lo + F.make_ym_interval(F.lit(1))).when(granularity == "week", lo + F.make_dt_interval(F.lit(7))).otherwise(lo + F.make_dt_interval(F.lit(1)))
    return lo, hi

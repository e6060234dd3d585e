"""Listing history: dedupe, upserts, merges, ledgers, retention, health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key (as row_number() <= n, which Spark also applies before the shuffle)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def semi(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(others.select(*keys), list(keys), "left_semi")


def anti(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(others.select(*keys), list(keys), "left_anti")


def retained(rows: DataFrame, as_of: str, days: int, seen: str = "last_seen") -> DataFrame:
    """Rows seen within so many days before as_of."""
    return rows.filter(F.col(seen) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def upsert(stored: DataFrame, new: DataFrame, key: str, first: str = "first_seen") -> DataFrame:
    """New rows replace stored ones of the same key; the earlier ``first`` stays."""
    other = new.select(*[F.col(c).alias(f"_n_{c}") for c in stored.columns])
    both = stored.join(other, F.col(key) == F.col(f"_n_{key}"), "full_outer")
    chosen = lambda c: F.when(F.col(f"_n_{key}").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(c))
    return both.select(*[(F.least(F.col(c), F.col(f"_n_{c}")) if c == first else chosen(c)).alias(c) for c in stored.columns])


def touch(stored: DataFrame, seen: DataFrame, key: str, last: str = "last_seen") -> DataFrame:
    """Stored rows whose key was seen get the later ``last``."""
    other = seen.groupBy(F.col(key).alias("_k")).agg(F.max(last).alias("_l"))
    return stored.join(other, F.col(key) == F.col("_k"), "left").withColumn(last, F.greatest(last, "_l")).select(*stored.columns)


def insert_or_replace(ledger: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    both = ledger.withColumn("_at", F.lit(0)).unionByName(rows.withColumn("_at", F.lit(1)))
    return both.groupBy(key).agg(*[F.max_by(c, F.struct("_at", *[x for x in ledger.columns if x != key])).alias(c) for c in ledger.columns if c != key]).select(*ledger.columns)


def merge_sparse(stored: DataFrame, fresh: DataFrame, key: str, defaults: dict[str, object], longer: Sequence[str] = (), flags: Sequence[str] = (), keep: Sequence[str] = ("first_seen",)) -> DataFrame:
    """Fresh rows, filled from stored ones: a default value gives way, the longer of two texts wins, flags are or-ed, ``keep`` stays stored."""
    old = stored.select(*[F.col(c).alias(f"_o_{c}") for c in stored.columns])
    both = fresh.join(old, F.col(key) == F.col(f"_o_{key}"), "left")

    def cell(c: str) -> Column:
        new, was = F.col(c), F.col(f"_o_{c}")
        if c == key:
            return new
        if c in keep:
            return F.coalesce(was, new)
        if c in flags:
            return F.coalesce(new, F.lit(False)) | F.coalesce(was, F.lit(False))
        if c in longer:
            return F.when(F.coalesce(F.length(new), F.lit(0)) > F.coalesce(F.length(was), F.lit(0)), new).otherwise(F.coalesce(was, new))
        return F.coalesce(F.nullif(new, F.lit(defaults[c])) if c in defaults else new, was, new)

    return both.select(*[cell(c).alias(c) for c in fresh.columns])


def merge_price_tables(primary: DataFrame, fallback: DataFrame, key: str = "name") -> DataFrame:
    """name, price, origin: the primary price where there is one; keys of the fallback alone are extras."""
    both = primary.select(key, F.col("price").alias("p")).join(fallback.select(key, F.col("price").alias("f")), key, "full_outer")
    return both.select(key, F.coalesce("p", "f").alias("price"), F.when(F.col("p").isNotNull(), "primary").otherwise("extra").alias("origin"))


def until_first_known(rows: DataFrame, source: str, pos: Sequence[str], known: str, most: int = 60) -> DataFrame:
    """Rows of each source in order, up to and including the first known one, ``most`` at most.

    The first ``most`` rows are taken before anything is sorted whole (Spark limits each group within its tasks), and only
    these are looked through for a known one.
    """
    head = keep_first(rows, [source], list(pos), most)
    before = Window.partitionBy(source).orderBy(*pos).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col(known).cast("int")).over(before), F.lit(0))
    return head.withColumn("_b", seen).filter(F.col("_b") == 0).drop("_b")


def source_health(attempts: DataFrame, source: str, at: str, ok: str, order: Sequence[str], interval_hours: int = 6, blocked_hours: str | None = None, as_of: str | None = None) -> DataFrame:
    """source, attempts, last_attempt_at, last_success_at, consecutive_failures, next_allowed_at from a log of attempts.

    ``blocked_hours`` names a column with the hours that an attempt blocked the source for (null or 0: it didn't); the last
    attempt's counts, as blocked_until. With ``as_of``, the flag due says whether the source may be asked again then: neither
    blocked nor before next_allowed_at. Consecutive failures are those after the last success, found by aggregation alone: no
    source is sorted in one task.
    """
    stamp = F.struct(at, *order)
    last = [F.max_by(F.col(blocked_hours), stamp).alias("_blocked")] if blocked_hours else []
    state = attempts.groupBy(source).agg(F.count("*").alias("attempts"), F.max(at).alias("last_attempt_at"), F.max(F.when(F.col(ok), stamp)).alias("_last"), *last)
    failed = attempts.filter(~F.col(ok)).withColumn("_at", stamp)
    late = failed.join(state.select(source, "_last"), source).filter(F.col("_last").isNull() | (F.col("_at") > F.col("_last")))
    late = late.groupBy(source).agg(F.count("*").alias("consecutive_failures"))
    out = state.join(late, source, "left").fillna(0, ["consecutive_failures"])
    after = lambda hours: F.col("last_attempt_at") + F.make_dt_interval(hours=hours)
    out = out.withColumns({"last_success_at": F.col(f"_last.{at}"), "next_allowed_at": after(F.lit(interval_hours))})
    names = [source, "attempts", "last_attempt_at", "last_success_at", "consecutive_failures", "next_allowed_at"]
    if blocked_hours:
        out = out.withColumn("blocked_until", F.when(F.col("_blocked") > 0, after(F.col("_blocked").cast("int"))))
        names.append("blocked_until")
    if as_of:
        now = F.lit(as_of).cast("timestamp")
        free = F.coalesce(F.col("blocked_until") <= now, F.lit(True)) if blocked_hours else F.lit(True)
        out = out.withColumn("due", free & (F.col("next_allowed_at") <= now))
        names.append("due")
    return out.select(*names)


def local_day(ts: Column, offset: str = "+03:30") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, offset))


def once_a_day(rows: DataFrame, stored: DataFrame, keys: Sequence[str], at: str, order: Sequence[Column], offset: str = "+03:30") -> DataFrame:
    """The first row of each key and local day (column day), unless that day is among the stored ones (keys, day) already."""
    dated = rows.withColumn("day", local_day(F.col(at), offset))
    return anti(keep_first(dated, [*keys, "day"], order), stored, [*keys, "day"])


def retained_tables(tables: dict[str, DataFrame], seen: dict[str, str], as_of: str, days: int) -> dict[str, DataFrame]:
    """The rows to keep of each table, by its column in ``seen``: listings and sent rows and runs by their stamp, schedules by their date."""
    if days < 1:
        raise ValueError("days must be at least 1")
    kept = {}
    for name, rows in tables.items():
        if dict(rows.dtypes)[seen[name]] == "date":
            kept[name] = rows.filter(F.col(seen[name]) >= F.date_sub(F.lit(as_of).cast("date"), days))
        else:
            kept[name] = retained(rows, as_of, days, seen[name])
    return kept

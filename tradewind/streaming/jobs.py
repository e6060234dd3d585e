"""The recurring scans as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.history import anti, keep_first, upsert
from ..sources.scratch import written


class _History(StatefulProcessor):
    """Per key: the last ``most`` arrivals as one value (ids, prices, times). Arrivals are evaluated against those of the ``keep_ms``
    before them, then added. A timer at the end of the last one's time drops the key."""

    def __init__(self, low: float, least: int, most: int, keep_ms: int | None):
        self.low, self.least, self.most, self.keep_ms = low, least, most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ids array<string>, prices array<bigint>, times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = self.seen.get() if self.seen.exists() else ([], [], [])
        known = [(i, int(p), int(t)) for i, p, t in zip(*state, strict=True)]
        before = max((t for _, _, t in known), default=None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["first_seen", "ad_id"]).itertuples(index=False):
            now = int(r.first_seen.value // 1_000_000)
            place = next((k for k, x in enumerate(known) if x[0] == r.ad_id), None)
            if place is not None:  # known: the price follows, its place stays
                known[place] = (r.ad_id, int(r.price), known[place][2])
                continue
            prices = [p for _, p, t in known if self.keep_ms is None or t >= now - self.keep_ms]
            if len(prices) >= self.least:
                mean = sum(prices) / len(prices)
                percent = (mean - r.price) / mean * 100
                if percent >= self.low:
                    out.append((r.ad_id, int(r.price), mean, percent, len(prices)))
            known = [*known, (r.ad_id, int(r.price), now)][-self.most :]
        self.seen.update(tuple(map(list, zip(*known, strict=True))))
        last = max(t for _, _, t in known)
        if self.keep_ms is not None and last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.keep_ms)
            self.handle.registerTimer(last + self.keep_ms)
        yield pd.DataFrame(out, columns=["ad_id", "price", "prior_avg", "discount_percent", "prior_n"])

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame([], columns=["ad_id", "price", "prior_avg", "discount_percent", "prior_n"])

    def close(self) -> None:
        pass


def prior_history_stream(listings: DataFrame, key: str, low: float = 4.0, least: int = 4, most: int = 10, days: int | None = None, late: str = "1 day") -> DataFrame:
    """Streaming deals of arriving listings (ad_id, price, first_seen, key) against the last arrivals of their key.

    On batches that arrive in order, with each id once, it gives the deals of prior_history_deals. With ``days``, only arrivals
    of that many days before a listing count, by the listings' own time: a replay or a backlog gives the same deals as
    prior_history_deals with ``days``. The state of a key goes when the watermark, ``late`` behind the newest first_seen, has
    passed the days of its last arrival; rows later than that are dropped.
    """
    schema = "ad_id string, price bigint, prior_avg double, discount_percent double, prior_n bigint"
    keep_ms = None if days is None else days * 86_400_000
    timed = listings if days is None else listings.withWatermark("first_seen", late)
    return timed.groupBy(key).transformWithStateInPandas(_History(low, least, most, keep_ms), schema, "append", "none" if days is None else "eventTime")


def new_listings(listings: DataFrame, key: str = "ad_id", at: str = "first_seen", keep: str = "45 days") -> DataFrame:
    """Each key once within ``keep``; older state expires by the watermark."""
    return listings.withWatermark(at, keep).dropDuplicatesWithinWatermark([key])


#: Buckets of the history, by a hash of the key.
BUCKETS = 64


class History:
    """A table of the latest row of each key, as Parquet files by bucket of the key, and versions of which files hold it.

    A version is a small table (bucket, path). A batch writes anew only the buckets that its keys fall into, beside the old files,
    and then the version that names the new ones; what it didn't touch stays where it is. A version is named by run and batch, so
    that a repeated batch writes it again, from the version before it.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def folders(self, path: str, prefix: str) -> list[int]:
        """Numbers of the folders prefix=number there."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{prefix}="))

    def drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def versions(self) -> list[tuple[int, int]]:
        root = f"{self.root}/versions"
        return [(r, b) for r in self.folders(root, "run") for b in self.folders(f"{root}/run={r}", "batch")]

    def files(self, version: tuple[int, int] | None) -> dict[int, str]:
        """Bucket -> folder, at most as many as there are buckets."""
        if version is None:
            return {}
        return {r.bucket: r.path for r in self.spark.read.parquet(f"{self.root}/versions/run={version[0]}/batch={version[1]}").collect()}

    def bucket_of(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, files: dict[int, str], buckets: Sequence[int] | None = None) -> DataFrame | None:
        paths = sorted({p for b, p in files.items() if buckets is None or b in buckets})
        return self.spark.read.parquet(*paths) if paths else None

    def merge(self, rows: DataFrame, key: str, version: tuple[int, int], merged: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[dict[int, str], DataFrame]:
        """Writes ``version``: merged(stored, rows) in the buckets of rows, on top of the newest version before. Gives its files,
        and the rows whose keys weren't stored."""
        files = self.files(max((v for v in self.versions() if v < version), default=None))
        touched = [r[0] for r in rows.select(self.bucket_of(key).alias("b")).distinct().collect()]
        stored = self.read(files, touched)
        current = (rows if stored is None else merged(stored, rows)).withColumn("_bucket", self.bucket_of(key))
        at = f"{self.root}/data/run={version[0]}/batch={version[1]}"
        current.repartition(len(touched) or 1, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(at)
        files = {**files, **{b: f"{at}/_bucket={b}" for b in touched}}
        listed = self.spark.createDataFrame(list(files.items()), "bucket int, path string")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/versions/run={version[0]}/batch={version[1]}")
        return files, rows if stored is None else anti(rows, stored, [key])

    def prune(self, keep: int) -> None:
        """Drops all but the newest versions, and the files that none of these names."""
        versions = self.versions()
        kept = versions[-keep:]
        used = {p for v in kept for p in self.files(v).values()}
        for run, batch in versions[:-keep]:
            at = f"{self.root}/data/run={run}/batch={batch}"
            for b in self.folders(at, "_bucket"):
                if f"{at}/_bucket={b}" not in used:
                    self.drop(f"{at}/_bucket={b}")
            # A version whose files are all gone needs no name; one that later versions still point into keeps its folder only.
            self.drop(f"{self.root}/versions/run={run}/batch={batch}")


def scan_job(
    listings: DataFrame,
    history: str,
    ledger: str,
    outbox: str,
    key: str,
    deals: Callable[[DataFrame, DataFrame], DataFrame],
    checkpoint: str,
    order: Sequence[Column],
    versions: int = 2,
    buckets: int = BUCKETS,
    counters: str | None = None,
) -> StreamingQuery:
    """Each micro-batch: history upsert, deals of the new listings, those not in the ledger to the outbox, then the ledger.

    Of rows that repeat a key in a batch, the first by ``order`` counts. History and ledger are tables by bucket of the key
    (History): a batch reads the ledger only where its deals may be, and writes anew only the buckets that it touches; the last
    ``versions`` are kept. Outbox rows lie in partitions of their batch, so that a repeated batch replaces what it wrote before. A
    new checkpoint starts a new run, which goes on from the history of the one before.

    With ``counters``, a folder, each batch also leaves a row there (run, batch, fetched, distinct_keys, new_keys, deals), counted
    as its tables are written (DataFrame.observe), without another pass over them.
    """
    spark = listings.sparkSession
    stored, sent = History(spark, history, buckets), History(spark, ledger, buckets)
    known = {n: spark.read.text(f"{history}/checkpoints/run={n}").first()[0] for n in stored.folders(f"{history}/checkpoints", "run")}
    this = next((n for n, c in known.items() if c == checkpoint), None)
    if this is None:
        this = max(known, default=-1) + 1
        spark.createDataFrame([(checkpoint,)], "checkpoint string").coalesce(1).write.mode("overwrite").text(f"{history}/checkpoints/run={this}")

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        now = (this, number)
        seen = {n: Observation(n) for n in ("fetched", "distinct_keys", "new_keys", "deals")}
        counted = lambda df, n: df.observe(seen[n], F.count(F.lit(1)).alias("n"))
        rows = written(counted(keep_first(counted(batch, "fetched"), [key], list(order)), "distinct_keys"))
        files, fresh = stored.merge(rows, key, now, lambda old, new: upsert(old, new, key))
        fresh = written(counted(fresh, "new_keys"))
        current = stored.read(files)
        found = written(deals(current, fresh)) if current is not None else None
        if found is not None:
            before = sent.files(max((v for v in sent.versions() if v < now), default=None))
            touched = [r[0] for r in found.select(sent.bucket_of(key)).distinct().collect()]
            told = sent.read(before, touched)
            found = found if told is None else anti(found, told, [key])
            at = f"{outbox}/run={this}/batch={number}"
            counted(found, "deals").write.mode("overwrite").parquet(at)
            sent.merge(session.read.parquet(at).select(key), key, now, lambda old, new: old.select(key).unionByName(new).distinct())
        for table in (stored, sent):
            table.prune(versions)
        if counters:
            figures = [(this, number, *(seen[n].get["n"] if found is not None else 0 for n in seen))]
            told = session.createDataFrame(figures, "run int, batch int, fetched long, distinct_keys long, new_keys long, deals long")
            told.coalesce(1).write.mode("overwrite").parquet(f"{counters}/run={this}/batch={number}")

    return listings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

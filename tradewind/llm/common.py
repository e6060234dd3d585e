"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract of this subpackage, for Java and for Python: space and U+0009 to U+000D.
SPACE = r"[ \t-\r]"


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    It lies in the folder that the session names in ``spark.checkpoint.dir``. Where that is unset, a temporary folder is made
    and set for the session, but only for a master on this machine: executors elsewhere could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tradewind.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tradewind-")
        spark.conf.set("tradewind.scratch", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and lets Catalyst know the size."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Maximal runs of characters other than SPACE; of null: an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fenced(rows: DataFrame, named: dict[str, str], replaced: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """(rows, inner, outer): the rows under names that can't clash with those an operator makes up.

    ``named`` maps columns that the operator reads to their names inside it. All columns but those in ``replaced`` are carried
    along as k0, k1, ... (``inner``), for ``outer`` has their own names back.
    """
    outer = [c for c in rows.columns if c not in replaced]
    inner = [f"k{i}" for i in range(len(outer))]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    read = [quoted(c).alias(n) for c, n in named.items()]
    return rows.select(*[quoted(c).alias(i) for c, i in zip(outer, inner, strict=True)], *read), inner, outer


def unfenced(rows: DataFrame, inner: Sequence[str], outer: Sequence[str], added: Sequence[str | Column]) -> DataFrame:
    """The carried columns under their own names, and those that the operator added."""
    return rows.select(*[F.col(i).alias(o) for i, o in zip(inner, outer, strict=True)], *added)


def fields_of(rows: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns as the fields of a schema string."""
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema]


def hashable(rows: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns that Spark can hash and order: all but maps and variants."""
    return [F.col(c) for c in columns if not any(x in dict(rows.dtypes)[c] for x in ("map<", "variant"))]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text that a sample may bring to the driver.
SAMPLE_BYTES = 1 << 25


def bounded_sample(df: DataFrame, rows: int, hashed: Column, text: Column, *columns: Column, most_bytes: int = SAMPLE_BYTES) -> list:
    """Rows (x, the text, and the columns) with the smallest hashes (ties by x and the columns); the same for the same rows.

    At most ``rows`` of them, and only as many as their texts, whole ones, stay within ``most_bytes`` in sum; a text that is
    longer by itself is passed over. Only rows below a bound of the hash that lets about four times as many through leave their
    tasks, without their texts, so what is sorted doesn't grow with the table; texts are fetched for the chosen rows only.
    """
    n = df.count()
    bound = min(1 << 40, (4 * rows << 40) // max(1, n))
    near = df.select(F.pmod(hashed, F.lit(1 << 40)).alias("h"), text.alias("x"), *columns).filter(F.col("h") < bound)
    near = near.withColumns({"size": F.coalesce(F.octet_length("x"), F.lit(0)).cast("long"), "d": F.xxhash64("x", *[c for c in near.columns if c not in ("h", "x")])})
    sizes = near.filter(F.col("size") <= most_bytes).groupBy("h", "d").agg(F.max("size").alias("size"), F.count("*").alias("n")).orderBy("h", "d").limit(rows).collect()
    chosen, left, room = [], rows, most_bytes
    for r in sizes:
        take = min(r["n"], left)
        if take < 1 or r["size"] * take > room:
            break
        chosen.append((r["h"], r["d"]))
        left, room = left - take, room - r["size"] * take
    if not chosen:
        return []
    last = F.struct(F.lit(chosen[-1][0]).alias("h"), F.lit(chosen[-1][1]).alias("d"))
    wanted = near.filter((F.struct("h", "d") <= last) & (F.col("size") <= most_bytes))
    return wanted.orderBy("h", "d").limit(rows).drop("h", "d", "size").collect()

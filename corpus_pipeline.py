"""A corpus pipeline over documents: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. Rows are told apart by a hash over all their columns; an empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.bpe import encode_documents
from tradewind.llm.common import materialize, table
from tradewind.llm.mixing import in_stream_order, mix_sources, mixed
from tradewind.llm.pii import find_personal_data
from tradewind.llm.quality import quality_rules
from tradewind.llm.registry import byte_bpe
from tradewind.llm.simhash import similar_documents


def _fresh(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash over all columns of each row, and the name of that column, which no other has."""
    name = _fresh(docs, "row")
    return docs.withColumn(name, F.xxhash64(*docs.columns, F.hash(*docs.columns))), name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    keyed, row = _keyed(docs)
    kept = quality_rules(keyed.select(F.col(row).alias("row"), "text", "source")).filter("kept").select(F.col("row").alias(row))
    return keyed.join(kept, row, "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): that with the smallest doc_id; of rows that repeat it, one."""
    keyed, row = _keyed(docs)
    groups = similar_documents(keyed.select("doc_id", F.col(row).alias("row"), "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    stay = materialize(groups.groupBy("root").agg(first.alias("s")).select(F.col("s.row").alias(row)))
    return keyed.join(stay, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind; n_chars follows the new text."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = find_personal_data(docs.select(F.struct(*rest).alias("rest"), "text"), redacted=True)
    size = F.length("redacted").cast(docs.schema["n_chars"].dataType)
    return found.select("rest.*", F.col("redacted").alias("text"), size.alias("n_chars")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mixed stream."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them, with slot and place in the mixed stream and in its order.

    Columns named like these results are replaced.

    The encoder deals the texts by hash, so the order is put back after it; slot and place depend on the rows alone, not on
    their order.
    """
    dropped = ("block", "release", "deadline")
    own = {c: _fresh(docs, c) for c in dropped if c in docs.columns}
    placed = mix_sources(docs.withColumnsRenamed(own)).drop(*dropped).withColumnsRenamed({n: c for c, n in own.items()})
    placed = materialize(placed)
    return in_stream_order(encode_documents(placed, **byte_bpe(), keep=("ids",)), placed)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("PII", personal_data), ("mixing", mixing), ("BPE", tokens)]

#: SQL can't express the fingerprints, the message passing, the schedule and the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs

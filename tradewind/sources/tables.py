"""Tables: the listings view over the star-schema tables, and reads with pushed-down filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings: ad_id (unique), repeat_key, brand, model, trim, year, price, mileage, city, cond, source_no, first_seen."""
    t = {n: read_table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier", "nation")}
    joined = (
        t["lineitem"]
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("ad_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("repeat_key"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("model"),
        F.col("l_returnflag").alias("trim"),
        (1380 + F.col("p_size") % 20).alias("year"),
        F.round("l_extendedprice").cast("bigint").alias("price"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("mileage"),
        F.col("n_name").alias("city"),
        F.col("l_linestatus").alias("cond"),
        (F.col("l_suppkey") % 8).alias("source_no"),
        F.col("l_shipdate").alias("first_seen"),
    )


#: The same view in SQL, for DuckDB.
LISTINGS_SQL = """ads as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int)) ad_id, concat_ws('-', l_orderkey, l_linenumber) repeat_key,
         p_brand brand, p_type model, l_returnflag trim, 1380 + p_size % 20 as year, cast(round(l_extendedprice) as bigint) price,
         cast(l_quantity * 1000 as bigint) mileage, n_name city, l_linestatus cond, l_suppkey % 8 source_no, l_shipdate first_seen
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"""

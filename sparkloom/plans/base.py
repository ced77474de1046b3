"""Registration of queries, and the views on the driver's tables that stand in for the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One verdict per line item: batch, atom, module, class, confidence, wave.
VERDICTS = """v AS (SELECT l_suppkey AS batch_id, l_orderkey * 8 + l_linenumber AS atom_id, p_brand AS module, l_linenumber AS wave,
  CASE WHEN l_quantity > 45 THEN 'REVIEW_REQUIRED' WHEN l_returnflag = 'A' THEN 'FIT' WHEN l_returnflag = 'N' THEN 'PARTIAL_FIT' ELSE 'GAP' END AS classification,
  round(l_discount * 10, 2) AS confidence, round(l_tax * 10, 2) AS top_score, l_quantity AS quantity, l_linestatus = 'F' AS reviewed
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    cls = F.when(F.col("l_quantity") > 45, "REVIEW_REQUIRED").when(F.col("l_returnflag") == "A", "FIT").when(F.col("l_returnflag") == "N", "PARTIAL_FIT").otherwise("GAP")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("batch_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("atom_id"), F.col("p_brand").alias("module"), F.col("l_linenumber").alias("wave"),
        cls.alias("classification"), F.round(F.col("l_discount") * 10, 2).alias("confidence"), F.round(F.col("l_tax") * 10, 2).alias("top_score"), F.col("l_quantity").alias("quantity"), (F.col("l_linestatus") == "F").alias("reviewed"),
    )


def counts(**conditions):
    """count_if columns."""
    return [F.count_if(c).alias(n) for n, c in conditions.items()]


CLASSES = ("FIT", "PARTIAL_FIT", "GAP", "REVIEW_REQUIRED")

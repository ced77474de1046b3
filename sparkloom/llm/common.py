"""Helpers shared by the training-data operators: shared storage, safe columns, let-binding."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: [\x20\x09-\x0D].
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: The same as a Java pattern.
SPACE_RE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a temporary one; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_STATE: dict = {}


def worker_state(key, build):
    """What `build` made for `key`, kept by a Python worker from task to task. A worker holds the state of one key at a time: another key (or None) frees it first."""
    if key not in _STATE:
        if _STATE:
            _STATE.clear()
            gc.collect()
        trim()
        if key is None:
            return None
        _STATE[key] = build()
    return _STATE[key]


def trim() -> None:
    """Give freed memory back to the system: an idle worker shall not hold what its last group took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # not glibc: nothing to trim


def trimmed(f, *args):
    """f(*args), with the memory it took given back."""
    try:
        return f(*args)
    finally:
        trim()


def trimmed_steps(steps):
    """The items of a generator; the memory goes back at its end."""
    try:
        yield from steps
    finally:
        trim()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


@contextmanager
def arrow_batches(spark: SparkSession, most: int):
    """While it lasts, jobs hand rows to Python in batches of about `most` bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def discard(written: DataFrame) -> None:
    """Delete the files of a `materialize` whose last reader has written its own result."""
    spark = written.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(written.__dict__["written_to"])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, also where `body` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows that `spread_join` broadcasts at most.
HOT_KEYS = 200_000


def spread_join(rows: DataFrame, facts: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined to facts (one row per key, with n: how many of the `total` rows have the key; n is left out of the result).

    Keys of more than total / HOT_KEYS rows (64 at least) are fewer than HOT_KEYS, so their facts are
    broadcast and their rows stay where they are; the others are shuffled, and none of them is large.
    A null key meets nothing, as in any join.
    """
    limit, columns = max(64, total // HOT_KEYS + 1), [c for c in facts.columns if c not in (key, "n")]
    hot = F.broadcast(facts.filter(F.col("n") > limit).select(key, F.struct(*columns).alias("__hot")))
    first = rows.join(hot, key, "left")
    found = first.filter(F.col("__hot").isNotNull()).select(*rows.columns, *(F.col(f"__hot.{c}").alias(c) for c in columns))
    rest = first.filter(F.col("__hot").isNull()).drop("__hot").join(facts.filter(F.col("n") <= limit).drop("n"), key, how)
    return found.unionByName(rest.select(*found.columns))


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

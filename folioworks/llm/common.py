"""What the operators of this folder share: shared storage, Arrow maps over texts, joins on hot keys."""

from __future__ import annotations

import math
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.shipping import ship_by_value

#: Keys that hold more than 1/HOT_SHARE of the rows are hot. There are never more than HOT_SHARE of them.
HOT_SHARE = 1024
#: Rows a Python task holds at a time.
BATCH_ROWS = 500


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only on an unset local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read again: later steps survive lost executors without recomputing what led here."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, so tables built by one task serve the next."""
    name = "_folioworks_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def map_texts(
    df: DataFrame, fn: Callable[[list[str | None]], Sequence[pa.Array]], fields: Sequence[tuple[str, str]], keep: Sequence[str], text: str = "text"
) -> DataFrame:
    """`keep` columns as they are, and `fields` (name, SQL type) that `fn` makes of every text, a batch at a time.

    New names win over kept columns of the same name.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    new = [n for n, _ in fields]
    keep = [c for c in dict.fromkeys(keep) if c not in new]
    made = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields)) if fields else T.StructType()
    schema = T.StructType([*(df.schema[c] for c in keep), *made.fields])
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    n = len(keep)

    def run(batches):
        for b in batches:
            arrays = fn(b.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *arrays], names=[*keep, *new])

    return src.mapInArrow(run, schema)


def hot_join(left: DataFrame, right: DataFrame, key: str, share: str = "n", how: str = "inner") -> DataFrame:
    """Join on a key that may hold any part of the left rows. `right` has one row per key and, in `share`, its number of left rows.

    Keys with more than 1/HOT_SHARE of the counted rows, of which HOT_SHARE exist at most, are broadcast; the rest are shuffled,
    and none of them is large. `left` is read twice: hand in a written table. `how` is inner or left.
    """
    total = right.agg(F.sum(share)).first()[0] or 0
    floor = math.ceil(total / HOT_SHARE)
    names = [c for c in right.columns if c not in (key, share)]
    right = right.where(F.col(key).isNotNull())
    hot = F.broadcast(right.where(F.col(share) > floor).select(key, *names, F.lit(True).alias("_hot")))
    cold = right.where(F.col(share) <= floor).select(key, *names)
    marked = left.join(hot, key, "left")
    a = marked.where("_hot").drop("_hot")
    b = left.join(hot.select(key), key, "left_anti").join(cold, key, how)
    return a.unionByName(b)


def crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")))


def text_key(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the values, nulls told from empty strings."""
    parts = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(7), *reversed(parts))]


ship_by_value(__name__)

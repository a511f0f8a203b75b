"""Append-only logs and dataset fingerprints."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.functions.text import digits_only


def _append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log, or no rows before its first entry."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(jpath) and any(not f.getPath().getName().startswith("_") for f in fs.listStatus(jpath))
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


RUN_SCHEMA = "run_no int, run string, created timestamp, kind string, model string, fingerprint string"


def _claim(spark: SparkSession, path: str, number: int) -> int:
    """The first number from `number` on that nobody has: its claim is a file that must not be there yet.

    A shared file system refuses the second of two creations itself; on a local one the check and the creation are one
    call of the operating system, as the Hadoop client would make them in two steps.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_claims")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    local = fs.getUri().getScheme() == "file"
    while True:
        try:
            if local:
                os.close(os.open(f"{folder.toUri().getPath()}/{number:09d}", os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return number
            if fs.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:09d}")):
                return number
        except FileExistsError:
            pass
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
        number += 1


def log_run(spark: SparkSession, path: str, name: str, kind: str, model: str, fingerprint: str = "") -> str:
    """Append a run under the next number; earlier runs are never touched. Writers at the same time get different numbers."""
    last = _read(spark, path, RUN_SCHEMA).agg(F.max("run_no")).first()[0] or 0
    number = _claim(spark, path, last + 1)
    run = f"exp_{number:03d}_{name}"
    row = spark.range(1).select(
        F.lit(run).alias("run"), F.current_timestamp().alias("created"), F.lit(kind).alias("kind"), F.lit(model).alias("model"), F.lit(fingerprint).alias("fingerprint"),
    )
    row.write.mode("errorifexists").parquet(f"{path}/run_no={number}")  # a folder of its own: two writers never share one
    return run


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, RUN_SCHEMA).select("run_no", "run", "created", "kind", "model", "fingerprint")


def log_test_use(spark: SparkSession, path: str, note: str = "") -> None:
    """Every evaluation on held-out data leaves a line."""
    _append(spark.range(1).select(F.current_timestamp().alias("time"), F.lit(note).alias("note")), path)


def log_number_views(views: DataFrame, path: str) -> None:
    """Views of sensitive numbers: the last four digits at most reach the log."""
    last4 = F.right(digits_only(F.col("number")), F.lit(4))
    _append(
        views.select(
            F.current_timestamp().alias("time"), "event", "client", F.lit(True).alias("consent_confirmed"),
            F.when(F.length(last4) == 4, last4).alias("number_last4"), F.col("check_digit_ok").cast("boolean").alias("check_digit_ok"),
        ),
        path,
    )


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n_rows, hash): the same for the same rows in any order and any partitioning."""
    cols = columns or df.columns
    h = F.xxhash64(*[F.to_json(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in cols])
    # the second mix keeps a row that occurs twice from cancelling out of the xor
    return df.agg(
        F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias("sum_hash"),
    ).select("n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), F.col("xor_hash").cast("string"), "sum_hash"), 256).alias("hash"))


def dataset_fingerprint(truth: DataFrame, split: DataFrame, version: str, seed: int) -> DataFrame:
    held = fingerprint(split).first()  # one row
    return fingerprint(truth).select(
        F.col("n_rows").alias("truth_rows"), F.col("hash").alias("truth_hash"), F.lit(held["n_rows"]).alias("split_rows"), F.lit(held["hash"]).alias("split_hash"),
        F.lit(version).alias("dataset_version"), F.lit(seed).alias("split_seed"),
    )

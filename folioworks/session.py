"""Session set-up, table loading and lineage cutting."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(cores: int | str = "*", app: str = "folioworks", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own session in."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("FOLIO_DRIVER_MEMORY", "12g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


#: Folders of the checkpoints written for the part that is being made; None outside `in_parts`.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("_WRITTEN", default=None)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize to the reliable checkpoint folder, so iterative plans stay short and survive lost executors."""
    _ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    written = _WRITTEN.get()
    if written is not None:
        written.append(out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    return out


#: One of so many parts of the keys: (number, of).
Part = tuple[int, int]


def of_part(key: Column, part: Part | None) -> Column:
    """Whether a whole number belongs to the part; without a part all do."""
    return F.lit(True) if part is None else F.pmod(F.xxhash64(key.cast("long")), F.lit(part[1])) == part[0]


def in_parts(spark: SparkSession, n: int, make: Callable[[Part | None], DataFrame]) -> DataFrame:
    """The rows of `make` of every part, one part after the other, so disk grows with the results and not with what leads to them.

    A part's rows are written to the checkpoint folder in columns; its checkpoints are then deleted, and its shuffles are left
    to Spark's cleaner, which comes after a collection of the driver's heap. One part alone is not written.
    """
    if n <= 1:
        return make(None)
    _ensure_checkpoint_dir(spark)
    top = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/parts-{uuid.uuid4().hex}"
    kept, schema = [], None
    for i in range(n):
        outer, written = _WRITTEN.get(), []
        _WRITTEN.set(written)
        try:
            rows = make((i, n))
            schema = rows.schema
            rows.write.option("compression", "zstd").parquet(f"{top}/{i}")
            kept.append(f"{top}/{i}")
        finally:
            _WRITTEN.set(outer)
            rows = None
            _drop(spark, written)
    return spark.read.schema(schema).parquet(*kept)


def _drop(spark: SparkSession, folders: list[str]) -> None:
    """Deletes checkpoints that nothing reads any more, and lets the cleaner see the shuffles of plans that are gone."""
    gc.collect()
    spark._jvm.System.gc()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly over the shuffle partitions before costly scoring, so one crowded task cannot hold it up."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over the shuffle partitions by keys, before each of them becomes many: a small file is read by one task, and
    all that is made from its rows without a shuffle would stay there. Later steps by the same keys need no shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

"""The batch extraction on a stream of page files. Pages of one file are held, keyed by file, until all of them are there."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioworks import schemas
from folioworks.shipping import ship_by_value
from folioworks.sources.records import page_lines, page_sizes, page_words

ship_by_value(__name__)

#: A page of an upload: the page as read, and how many pages its file has (null: not known).
UPLOAD = T.StructType([*schemas.OCR_PAGE.fields, T.StructField("n_pages", T.IntegerType())])


def read_page_stream(spark: SparkSession, path: str, late: str = "1 hour", files_per_batch: int | None = None) -> DataFrame:
    """Pages as they arrive, in any order and any number of times. Time is when a page arrived, and `late` how long it is waited for."""
    reader = spark.readStream.schema(UPLOAD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).withColumn("arrived", F.col("_metadata.file_modification_time")).withWatermark("arrived", late)


def hold_until_complete(pages: DataFrame) -> DataFrame:
    """(file, page, complete, body): all pages of a file at once, each page once, when as many are there as it has.

    The state of a file is its pages so far; once they are passed on only a mark stays, by which repeats are dropped. When
    the watermark has passed the last page that arrived, pages of a file that never became complete are passed on as they
    are, with complete false, and marks are forgotten.
    """

    def hold(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n, passed, last = (json.loads(state.get[0]), *state.get[1:]) if state.exists else ({}, 0, False, 0)

        def out(complete: bool) -> pd.DataFrame:
            rows = sorted((int(p), body) for p, body in held.items())
            return pd.DataFrame({"file": key[0], "page": pd.Series([p for p, _ in rows], dtype="int32"), "complete": complete, "body": [b for _, b in rows]})

        if state.hasTimedOut:
            state.remove()
            if not passed and held:
                yield out(False)
            return
        for pdf in batches:
            last = max(last, *(int(t) for t in pdf["arrived_ms"]))
            for page, count, body in zip(pdf["page"], pdf["n_pages"], pdf["body"]):
                if not passed:
                    held.setdefault(str(int(page)), body)
                    n = max(n, 0 if pd.isna(count) else int(count))
        if not passed and 0 < n <= len(held):
            yield out(True)
            held, passed = {}, True
        state.update((json.dumps(held), n, passed, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)

    body = F.to_json(F.struct(*[F.col(f.name) for f in schemas.OCR_PAGE.fields]))
    slim = pages.where("file IS NOT NULL AND page IS NOT NULL").select("file", "page", "n_pages", "arrived", F.unix_millis("arrived").alias("arrived_ms"), body.alias("body"))
    return slim.groupBy("file").applyInPandasWithState(
        hold, "file string, page int, complete boolean, body string", "held string, n int, passed boolean, last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_extraction(pages: DataFrame, out: str, checkpoint: str, extract: Callable[[DataFrame, DataFrame, DataFrame], dict[str, DataFrame]],
                   tables: tuple[str, ...] = ("values", "subjects", "issues", "documents")) -> StreamingQuery:
    """Extract what each micro-batch completes and write its tables under its own batch folder, so a replayed batch
    replaces itself. Files passed on without all their pages are named in the table `incomplete`."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            whole = batch.select(F.from_json("body", schemas.OCR_PAGE).alias("p")).select("p.*")
            result = extract(page_lines(whole), page_words(whole), page_sizes(whole))
            result["incomplete"] = batch.where("NOT complete").groupBy("file").agg(F.count("*").alias("pages_read"))
            for t in (*tables, "incomplete"):
                result[t].write.mode("overwrite").parquet(f"{out}/{t}/batch={batch_id}")
        finally:
            batch.unpersist()

    held = hold_until_complete(pages)
    return held.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

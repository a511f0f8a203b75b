"""Readers and writers: JSON lines, nested page JSON, file scans, per-partition manifests, resumable runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks import schemas


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, bad: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines); blank lines are skipped."""
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", wide, {"columnNameOfCorruptRecord": bad, "mode": "PERMISSIVE"})
    parsed = lines.select(row.alias("_r")).select("_r.*")
    return parsed.where(F.col(bad).isNull()).drop(bad), parsed.where(F.col(bad).isNotNull()).select(bad)


def write_counted(df: DataFrame, path: str, fmt: str = "json", mode: str = "error", by: list[str] | None = None) -> int:
    """Write and return the row count, counted while writing rather than by a second pass."""
    seen = Observation("written")
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).format(fmt)
    (out.partitionBy(*by) if by else out).save(path)
    return seen.get["n"]


def write_manifests(assigned: DataFrame, path: str, mode: str = "error") -> int:
    """One folder per split partition, so a reader of one partition never opens the others."""
    return write_counted(assigned, path, "json", mode, ["partition"])


def read_pages(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schemas.OCR_PAGE).option("multiLine", multiline).json(path)


def _boxed(item: str) -> list[Column]:
    return [F.get(F.col(f"{item}.bbox"), i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]


def page_words(pages: DataFrame) -> DataFrame:
    return pages.select("file", "page", F.explode("words").alias("w")).select(
        "file", "page", F.col("w.id").alias("word_id"), F.col("w.line_id").alias("line_id"), F.col("w.text").alias("text"), *_boxed("w"), F.col("w.confidence").alias("conf")
    )


def page_lines(pages: DataFrame) -> DataFrame:
    return pages.select("file", "page", F.explode("lines").alias("l")).select(
        "file", "page", F.col("l.id").alias("line_id"), F.col("l.text").alias("text"), *_boxed("l"), F.col("l.confidence").alias("conf")
    )


def page_sizes(pages: DataFrame) -> DataFrame:
    """The page index: size of each page, with role when the pages carry one."""
    role = F.col("role") if "role" in pages.columns else F.lit("certificate")
    return pages.select("file", "page", "width", "height", role.alias("role"))


def labelled_words(spark: SparkSession, path: str, notes: bool = True) -> DataFrame:
    """Word labels per page; notes pages can be left out."""
    raw = spark.read.schema(schemas.LABELLED_PAGES).json(path)
    p = raw.select("file", "partition", F.explode("pages").alias("p"))
    if not notes:
        p = p.where("p.role <> 'notes'")
    return p.select("file", "partition", F.col("p.page").alias("page"), F.col("p.width").alias("width"), F.col("p.height").alias("height"), F.explode("p.words").alias("w")).select(
        "file", "partition", "page", "width", "height", F.col("w.id").alias("word_id"), F.col("w.text").alias("text"), *_boxed("w"), F.col("w.ocr_confidence").alias("conf"), F.col("w.label").alias("label")
    )


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file, sha256, bytes of each file; only the digest leaves the scan."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.regexp_replace("path", "^.*/", "").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def pending(inputs: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Inputs without output yet; all of them when forced."""
    return inputs if force else inputs.join(done.select(key), key, "left_anti")


def read_manifest(spark: SparkSession, path: str, schema: T.StructType, partition: str) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("partition", T.StringType())])
    return spark.read.schema(full).json(path).where(F.col("partition") == partition)


def phrase_table(spark: SparkSession, phrases: dict[str, list[tuple[str, float]]]) -> DataFrame:
    """A phrase dimension: label order, label, phrase, weight. The lists are fixed and short."""
    rows = [(i, label, p, w) for i, (label, ps) in enumerate(phrases.items()) for p, w in ps]
    return spark.createDataFrame(rows, "label_order int, label string, phrase string, weight double")

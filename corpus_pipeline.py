"""Training text from raw documents: each stage works on all that the one before it kept.

Toxic documents go, lines that a source repeats go, one document of every near-duplicate group stays, personal data is
masked, and what is left is packed into sequences. Tables are Parquet between the stages, in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import boilerplate, common, neardup, packing, pii, toxicity
from folioworks.session import table


def _recounted(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of `docs`, with n_chars as long as the new text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under the threshold."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    given = {c: f"_given_{c}" for c in docs.columns if c in ("score", "n_signs")}  # names that the operator takes
    scored = toxicity.score(docs.withColumnsRenamed(given), model, [given.get(c, c) for c in docs.columns])
    kept = scored.where(F.col("score") < toxicity.THRESHOLD).drop("score", "n_signs")
    return kept.withColumnsRenamed({v: k for k, v in given.items()}).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that their source repeats."""
    return _recounted(docs, boilerplate.drop_boilerplate(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that shingles of five words link from a similarity of 0.8."""
    return neardup.drop_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return _recounted(docs, pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    placed = packing.pack(packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", keep_clean),
    ("line dedup", drop_boilerplate),
    ("near dedup", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("packing", pack),
]

#: The scores of the first stage, and so its rows, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs

"""From model scores to labelled spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks import vocab

_WORD = ["file", "page", "word_id"]


def word_probabilities(scores: DataFrame) -> DataFrame:
    """Mean score per (word, label) over overlapping windows, then softmax across the word's labels."""
    mean = scores.groupBy(*_WORD, "label").agg(F.avg("logit").alias("z"))
    per = Window.partitionBy(*_WORD)
    e = mean.withColumn("_e", F.exp(F.col("z") - F.max("z").over(per)))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(per)).select(*_WORD, "label", "p")


def best_labels(probabilities: DataFrame) -> DataFrame:
    """The likeliest label of each word; the smaller label name wins an exact tie."""
    best = F.min(F.struct((-F.col("p")).alias("_n"), "label", "p")).alias("b")
    return probabilities.groupBy(*_WORD).agg(best).select(*_WORD, "b.label", "b.p")


def with_best_label(words: DataFrame, scores: str = "scores") -> DataFrame:
    """Words with label and p, as `word_probabilities` and `best_labels` give them, from the scores each word carries: an array of
    (label, logit), one for every window over the word. Nothing is shuffled, for a word's scores are already together."""
    mean = lambda of: F.aggregate(of, F.lit(0.0), lambda a, s: a + s["logit"]) / F.size(of)
    names = F.array_distinct(F.transform(scores, lambda s: s["label"]))
    z = F.transform(names, lambda n: F.struct(n.alias("label"), mean(F.filter(scores, lambda s: s["label"] == n)).alias("z")))
    w = words.withColumn("_z", z).withColumn("_top", F.array_max(F.transform("_z", lambda s: s["z"])))
    w = w.withColumn("_sum", F.aggregate("_z", F.lit(0.0), lambda a, s: a + F.exp(s["z"] - F.col("_top"))))
    p = lambda s: F.exp(s["z"] - F.col("_top")) / F.col("_sum")
    best = F.array_min(F.transform("_z", lambda s: F.struct((-p(s)).alias("n"), s["label"].alias("label"), p(s).alias("p"))))
    return w.withColumn("_b", best).select(*[c for c in words.columns if c != scores], "_b.label", "_b.p")


def decode_spans(words: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Spans in reading order of text lines. A new one starts at B-, at another label, at single-word labels, at a
    word without scores before it, and for subjects at a new line. Confidence: least probability x reading confidence.
    Without `labels` the words have label and p themselves."""
    w = words if labels is None else words.join(labels, _WORD, "left")
    order = Window.partitionBy("file", "page").orderBy("line_id", "x0", "word_id")
    bare = F.when(F.col("label").isNull() | (F.col("label") == "O"), None).otherwise(F.regexp_replace("label", "^[BI]-", ""))
    w = w.withColumn("entity", bare)
    same = F.lag("entity").over(order) == F.col("entity")
    new_line = (F.lag("line_id").over(order) != F.col("line_id")) & (F.col("entity") == "SUBJECT")
    start = F.col("label").startswith("B-") | ~F.coalesce(same, F.lit(False)) | F.col("entity").isin(vocab.SINGLE_WORD_LABELS) | F.coalesce(new_line, F.lit(False))
    w = w.withColumn("_new", F.when(F.col("entity").isNotNull() & start, 1).otherwise(0))
    w = w.withColumn("span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("entity is not null")
    item = F.struct("line_id", "x0", "word_id", "text")
    return w.groupBy("file", "page", "span", "entity").agg(
        F.array_sort(F.collect_list(item)).alias("_w"), F.round(F.min(F.col("p") * F.col("conf")), 4).alias("confidence"), F.min("conf").alias("conf"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    ).select("file", "page", F.col("entity").alias("label"), F.col("_w")["word_id"].alias("word_ids"), F.array_join(F.col("_w")["text"], " ").alias("text"), "x0", "y0", "x1", "y1", "conf", "confidence")

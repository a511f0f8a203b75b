"""Accuracy of predictions against truth. Blank truth means unannotated and is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks import vocab
from folioworks.functions import text as t
from folioworks.functions.similarity import cer, indel_ratio, levenshtein_similarity
from folioworks.functions.stats import share, wilson_bounds
from folioworks.operators.matching import greedy_match
from folioworks.operators.truth import unpivot_text


def comparison_key(field: Column, value: Column) -> Column:
    """The form under which two values of a field count as equal."""
    text = F.coalesce(value, F.lit(""))
    upper = F.upper(F.trim(text))
    number = lambda digits: F.round(value.try_cast("double"), digits).cast("string")
    return (
        F.when(field == "document_type", t.document_kind(value))
        .when(field == "state", F.trim(text))
        .when(field == "board", t.board_id(value))
        .when(field.isin("student_name", "father_name", "mother_name", "course"), t.collapse_ws(value))
        .when(field == "hall_ticket_number", t.digits_only(value))
        .when(field.isin("year_of_pass", "total_marks", "maximum_marks"), value.try_cast("int").cast("string"))
        .when(field.isin("month_of_pass", "group"), upper)
        .when(field == "medium", t.categorical_note(F.when(field == "medium", text), vocab.MEDIA)["value"])
        .when(field == "result", t.categorical_note(F.when(field == "result", text), vocab.RESULTS)["value"])
        .when(field == "percentage", number(1))
        .when(field == "cgpa", number(2))
        .otherwise(text)
    )


def field_pairs(truth: DataFrame, predicted: DataFrame, fields: list[str], key: str = "file") -> DataFrame:
    """(key, field, truth, pred) over annotated values only."""
    a = unpivot_text(truth, [key], fields).withColumnRenamed("value", "truth").where(~t.blank(F.col("truth")))
    b = unpivot_text(predicted, [key], fields).withColumnRenamed("value", "pred")
    keys = truth.select(key).join(predicted.select(key), key, "left_semi")
    return a.join(keys, key, "left_semi").join(b, [key, "field"], "left")


def judge_pairs(pairs: DataFrame, issues: DataFrame | None = None, key: str = "file") -> DataFrame:
    """Adds keys, correctness, error measures and whether the truth value is under an open issue."""
    f = F.col("field")
    out = pairs.withColumn("tk", comparison_key(f, F.col("truth"))).withColumn(
        "pk", F.when(~t.blank(F.col("pred")), comparison_key(f, F.col("pred")))
    )
    is_text = f.isin(vocab.TEXT_FIELDS)
    ps, ts = F.coalesce("pk", F.lit("")), F.coalesce("tk", F.lit(""))
    out = (
        out.withColumn("correct", F.coalesce(F.col("pk") == F.col("tk"), F.lit(False)))
        .withColumn("cer", F.when(is_text, cer(ps, ts)))
        .withColumn("similarity", F.when(is_text, levenshtein_similarity(ps, ts)))
        .withColumn("loose", F.when(is_text, F.col("pk").isNotNull() & (t.alnum_key(ps) == t.alnum_key(ts))))
        .withColumn("abs_error", F.when(f == "total_marks", F.abs(F.col("pk").try_cast("long") - F.col("tk").try_cast("long"))))
    )
    if issues is None:
        return out.withColumn("flagged_truth", F.lit(False))
    bad = issues.where(F.col("severity").isin("warning", "error")).select(key, "field").distinct().withColumn("_f", F.lit(True))
    return out.join(bad, [key, "field"], "left").withColumn("flagged_truth", F.coalesce("_f", F.lit(False))).drop("_f")


def field_metrics(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One aggregation for every field, over all annotated values and over those with clean truth."""
    subset = F.explode(F.when(F.col("flagged_truth"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("clean_truth"))))
    n, k = F.count("*"), F.count_if(F.col("correct"))
    low, high = wilson_bounds(F.col("exact_match"), F.col("n_annotated"))
    agg = judged.withColumn("subset", subset).groupBy(*(by or []), "field", "subset").agg(
        n.alias("n_annotated"),
        F.count_if(~t.blank(F.col("pred"))).alias("n_predicted"),
        k.alias("exact_match"),
        F.count_if(F.col("loose")).alias("_loose"),
        F.count("loose").alias("_text"),
        F.round(F.avg("cer"), 4).alias("mean_cer"),
        F.round(F.avg("similarity"), 4).alias("mean_similarity"),
        F.round(F.avg("abs_error"), 2).alias("mae_when_predicted"),
    )
    return (
        agg.withColumn("accuracy", share(F.col("exact_match"), F.col("n_annotated")))
        .withColumn("wilson_low", low)
        .withColumn("wilson_high", high)
        .withColumn("accuracy_ignoring_spacing", share(F.col("_loose"), F.col("_text")))
        .drop("_loose", "_text")
    )


def subject_edges(truth_rows: DataFrame, pred_rows: DataFrame, key: str = "file") -> DataFrame:
    """Candidate (i, j, score) pairs of one record's truth and predicted subject rows."""
    a = truth_rows.select(key, F.col("pos").alias("i"), t.subject_match_key(F.col("subject_name")).alias("an"), F.col("paper").alias("ap"), F.col("marks").alias("am"))
    b = pred_rows.select(key, F.col("pos").alias("j"), t.subject_match_key(F.col("subject_name")).alias("bn"), F.col("paper").alias("bp"), F.col("marks").alias("bm"))
    sim = levenshtein_similarity(F.col("an"), F.col("bn"))
    bonus = F.when(F.col("ap").eqNullSafe(F.col("bp")), 10).otherwise(0) + F.when(F.col("am").eqNullSafe(F.col("bm")), 5).otherwise(0)
    # the length bound drops most non-matches before any distance is computed
    near = F.least(F.length("an"), F.length("bn")) >= 0.6 * F.greatest(F.length("an"), F.length("bn"))
    return a.join(b, key).where(near).withColumn("sim", sim).where("sim >= 0.6").select(key, "i", "j", (F.col("sim") * 100 + bonus).alias("score"))


def match_subject_rows(truth_rows: DataFrame, pred_rows: DataFrame, key: str = "file") -> DataFrame:
    """Every truth row with its matched predicted row (or none) and what agrees."""
    pairs = greedy_match(subject_edges(truth_rows, pred_rows, key), [key], "i", "j", "score").select(key, "i", "j")
    a = truth_rows.select(key, F.col("pos").alias("i"), F.struct("subject_name", "paper", "marks", "maximum_marks").alias("t"))
    b = pred_rows.select(key, F.col("pos").alias("j"), F.struct("subject_name", "paper", "marks", "maximum_marks").alias("p"))
    out = a.join(pairs, [key, "i"], "left").join(b, [key, "j"], "left")
    has = F.col("p").isNotNull()
    same = lambda f: has & F.col(f"p.{f}").eqNullSafe(F.col(f"t.{f}"))
    out = (
        out.withColumn("name_ok", has & (t.subject_match_key(F.col("p.subject_name")) == t.subject_match_key(F.col("t.subject_name"))))
        .withColumn("paper_ok", same("paper")).withColumn("marks_ok", same("marks")).withColumn("maximum_ok", same("maximum_marks"))
    )
    return out.withColumn("complete_row", F.col("name_ok") & F.col("paper_ok") & F.col("marks_ok") & F.col("maximum_ok"))


def subject_metrics(matched: DataFrame, pred_rows: DataFrame, flagged_docs: DataFrame | None = None, key: str = "file") -> DataFrame:
    """Row rates, row precision and fully exact records, over all records and those with clean truth."""
    n_pred = pred_rows.groupBy(key).agg(F.count("*").alias("pred_rows"))
    flags = ["name_ok", "paper_ok", "marks_ok", "maximum_ok", "complete_row"]
    docs = matched.groupBy(key).agg(
        F.count("*").alias("truth_rows"), F.count("j").alias("matched_pred_rows"),
        *[F.count_if(F.col(f)).alias(f) for f in flags],
    ).join(n_pred, key, "left").fillna(0, ["pred_rows"])
    docs = docs.withColumn("exact_doc", (F.col("complete_row") == F.col("truth_rows")) & (F.col("pred_rows") == F.col("truth_rows")))
    if flagged_docs is not None:
        docs = docs.join(flagged_docs.select(key).distinct().withColumn("_f", F.lit(True)), key, "left")
    else:
        docs = docs.withColumn("_f", F.lit(None).cast("boolean"))
    subset = F.explode(F.when(F.col("_f"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("clean_truth"))))
    out = docs.withColumn("subset", subset).groupBy("subset").agg(
        F.count("*").alias("docs"), F.count_if("exact_doc").alias("docs_all_rows_exact"),
        *[F.sum(c).alias(c) for c in ("truth_rows", "pred_rows", "matched_pred_rows", *flags)],
    )
    for f in flags:
        name = f.removesuffix("_ok")
        low, high = wilson_bounds(F.col(f), F.col("truth_rows"))
        out = out.withColumn(f"{name}_accuracy", share(F.col(f), F.col("truth_rows"))).withColumn(f"{name}_low", low).withColumn(f"{name}_high", high)
    return out.withColumn("row_precision", share(F.col("matched_pred_rows"), F.col("pred_rows")))


def label_prf(words: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Precision, recall and F1 per label and overall ('*'); a wrong label is a miss for one and a false hit for the other."""
    bare = lambda c: F.when(F.col(c) == "O", "O").otherwise(F.regexp_replace(c, "^[BI]-", ""))
    counts = (
        words.where(F.col(pred).isNotNull() & (F.col(gold) != "IGNORE"))
        .groupBy(bare(gold).alias("g"), bare(pred).alias("q")).agg(F.count("*").alias("n"))
    )
    hit = F.col("g") == F.col("q")
    rows = counts.select(
        F.explode(
            F.filter(
                F.array(
                    F.when(hit & (F.col("g") != "O"), F.struct(F.col("g").alias("label"), F.col("n").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))),
                    F.when(~hit & (F.col("q") != "O"), F.struct(F.col("q").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fp"), F.lit(0).cast("long").alias("fn"))),
                    F.when(~hit & (F.col("g") != "O"), F.struct(F.col("g").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("n").alias("fn"))),
                ),
                lambda r: r.isNotNull(),
            )
        ).alias("r")
    ).select("r.*")
    out = (
        rows.select(F.explode(F.array(F.lit("*"), F.col("label"))).alias("label"), "tp", "fp", "fn")
        .groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rate = lambda a, b: F.coalesce(share(a, b), F.lit(0.0))
    return out.select("label", "tp", "fp", "fn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"),
                      rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classification_agreement(truth: DataFrame, classes: DataFrame, key: str = "file") -> DataFrame:
    """agree / disagree / no truth, over every classified document."""
    both = classes.select(key, F.col("document_type").alias("predicted")).join(truth.select(key, F.col("document_type").alias("truth_type")), key, "left")
    agrees = (F.col("truth_type") == vocab.TARGET_DOCUMENT_TYPE) == (F.col("predicted") == vocab.CERTIFICATE)
    return both.withColumn("outcome", F.when(F.col("truth_type").isNull(), "no_truth").when(agrees, "agree").otherwise("disagree")).groupBy("outcome").agg(F.count("*").alias("n"))


def categorize_errors(wrong: DataFrame) -> DataFrame:
    """The likely cause of each wrong field value, from the evidence beside it.

    Needs field, truth, pred, supported, flagged_truth, align_status, label_value, suggestion, same_place.
    """
    c = F.col
    blank_pred = t.blank(c("pred"))
    score = lambda a, b: indel_ratio(t.alnum_key(a), t.alnum_key(b))
    out = (
        wrong.withColumn("_sim", score(c("pred"), c("truth")))
        .withColumn("_label", score(c("pred"), c("label_value")))
        .withColumn("_hint", score(c("pred"), c("suggestion")))
    )
    missed = c("align_status").isin("review", "not_found")
    has = lambda f: ~t.blank(c(f))
    category = (
        F.when(~c("supported"), "unsupported_document")
        .when(c("flagged_truth"), "truth_annotation_issue")
        .when(c("field") == "maximum_marks", "truth_annotation_issue")
        .when(c("field") == "percentage", "normalization_error")
        .when(c("field").isin("state", "board", "document_type"), "field_association_error")
        .when(blank_pred & (c("align_status") == "accepted"), "layout_error")
        .when(blank_pred, "ocr_error")
        .when((c("_sim") == 100) & (c("pred") != c("truth")), "ocr_error")
        .when(missed & has("label_value") & (c("_label") >= 90) & (c("_sim") < 90), "truth_annotation_issue")
        .when((c("align_status") == "accepted") & c("same_place"), "normalization_error")
        .when(c("align_status") == "accepted", "field_association_error")
        .when(c("_sim") >= 80, "ocr_error")
        .when(missed & has("suggestion") & (c("_hint") >= 90), "truth_annotation_issue")
        .otherwise("field_association_error")
    )
    return out.withColumn("category", category).withColumnRenamed("_sim", "text_similarity").drop("_label", "_hint")


def categorize_subject_errors(rows: DataFrame) -> DataFrame:
    """Cause of each subject row that is not complete. Needs match flags, p, doc_flagged and align_status."""
    c = F.col
    return rows.where(~c("complete_row")).withColumn(
        "category",
        F.when(c("doc_flagged"), "truth_annotation_issue")
        .when(c("align_status").isNotNull() & (c("align_status") != "accepted"), "ocr_error")
        .when(c("p").isNull(), "table_extraction_error")
        .when(c("name_ok") & ~(c("marks_ok") & c("maximum_ok")), "table_extraction_error")
        .when(~c("paper_ok"), "table_extraction_error")
        .otherwise("normalization_error"),
    )


def evaluation_report(truth: DataFrame, predicted: DataFrame, issues: DataFrame, alignment: DataFrame, supported: DataFrame,
                      partition: str, key: str = "file", log_path: str | None = None) -> dict[str, DataFrame]:
    """Field metrics, wrong values with their cause, and cause counts for one partition."""
    if partition == "test" and log_path:
        from folioworks.sources.logs import log_test_use

        log_test_use(truth.sparkSession, log_path, partition)
    judged = judge_pairs(field_pairs(truth, predicted, [f for f in vocab.REPORT_FIELDS], key), issues, key)
    align_field = t.literal_map({f: lab for lab, fs in vocab.TRUTH_FIELD_OF.items() if lab != "TOTAL_IN_WORDS" for f in fs})
    a = alignment.select(key, F.col("field").alias("_label"), F.col("status").alias("align_status"), "label_value", "suggestion")
    wrong = (
        judged.where("not correct").withColumn("_label", F.try_element_at(align_field, F.col("field")))
        .join(a, [key, "_label"], "left").join(supported.select(key, "supported"), key, "left")
        .withColumn("supported", F.coalesce("supported", F.lit(True))).withColumn("same_place", F.lit(False))
    )
    errors = categorize_errors(wrong)
    return {
        "fields": field_metrics(judged).withColumn("partition", F.lit(partition)),
        "errors": errors,
        "categories": errors.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category"),
    }

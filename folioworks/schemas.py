"""Explicit schemas. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

_BOX = T.ArrayType(T.IntegerType())

OCR_WORD = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("line_id", T.IntegerType()), T.StructField("text", T.StringType()),
    T.StructField("bbox", _BOX), T.StructField("confidence", T.DoubleType()),
])
OCR_LINE = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("bbox", _BOX),
    T.StructField("confidence", T.DoubleType()),
])
OCR_PAGE = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("rotation", T.IntegerType()),
    T.StructField("lines", T.ArrayType(OCR_LINE)), T.StructField("words", T.ArrayType(OCR_WORD)),
])
SUBJECT = T.StructType([
    T.StructField("subject_name", T.StringType()), T.StructField("paper", T.StringType()),
    T.StructField("marks", T.IntegerType()), T.StructField("maximum_marks", T.IntegerType()),
])
TRUTH = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("document_type", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("board", T.StringType()), T.StructField("student_name", T.StringType()), T.StructField("father_name", T.StringType()),
    T.StructField("mother_name", T.StringType()), T.StructField("hall_ticket_number", T.StringType()),
    T.StructField("year_of_pass", T.IntegerType()), T.StructField("month_of_pass", T.StringType()),
    T.StructField("course", T.StringType()), T.StructField("group", T.StringType()), T.StructField("medium", T.StringType()),
    T.StructField("subjects", T.ArrayType(SUBJECT)), T.StructField("total_marks", T.IntegerType()),
    T.StructField("maximum_marks", T.IntegerType()), T.StructField("percentage", T.DoubleType()),
    T.StructField("result", T.StringType()), T.StructField("cgpa", T.DoubleType()),
])
ISSUE = T.StructType([T.StructField(c, T.StringType()) for c in ("file", "field", "check", "severity", "truth_value", "detail", "status")])
LINE = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("line_id", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("x0", T.IntegerType()), T.StructField("y0", T.IntegerType()),
    T.StructField("x1", T.IntegerType()), T.StructField("y1", T.IntegerType()), T.StructField("conf", T.DoubleType()),
])
WORD = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("word_id", T.IntegerType()),
    T.StructField("line_id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("x0", T.IntegerType()),
    T.StructField("y0", T.IntegerType()), T.StructField("x1", T.IntegerType()), T.StructField("y1", T.IntegerType()),
    T.StructField("conf", T.DoubleType()),
])
PAGE = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("role", T.StringType()),
])
LABELLED_PAGES = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("partition", T.StringType()),
    T.StructField("pages", T.ArrayType(T.StructType([
        T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
        T.StructField("role", T.StringType()),
        T.StructField("words", T.ArrayType(T.StructType([
            T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("bbox", _BOX),
            T.StructField("ocr_confidence", T.DoubleType()), T.StructField("label", T.StringType()),
        ]))),
    ]))),
])

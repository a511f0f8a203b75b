"""Quality by weak supervision.

Each rule looks at one count of a document and votes good (1), bad (-1) or abstains (0). Nobody knows beforehand how far a
rule can be trusted: expectation-maximisation over all documents' votes estimates every rule's accuracy in both classes and
the share of good documents, and a document is kept when its posterior probability of being good is a half or more.
Documents with equal votes are counted together, so the estimation sees a table of vote patterns whose size the number of
rules fixes, not the data.

A null text has no words and, like an empty one, fails the base rule. Repeated rows are counted as rows of their own. An empty
table gives an empty result. Only the columns named in `keep` are carried.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common
from folioworks.shipping import ship_by_value

WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Words that running text in the corpus' languages is full of. Fixed values.
FUNCTION_WORDS = (
    "the of and to in a is it that for on are with as was at by this be or from "
    "der die das und in zu den mit von für ist nicht ein eine auf "
    "de la le les et des en un une du que est pour dans par sur "
    "el los las y que en un una por con para se no su al lo"
).split()

COUNTS = [(n, "bigint") for n in "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_function_words n_capitals n_shouts".split()]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words which the text holds twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ (h[k : k + n] + np.uint64(k))
        mixed ^= mixed >> np.uint64(29)
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS, over the whole text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()  # bytes are split at U+0009 to U+000D and U+0020, and nowhere else
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    known = _function_words()
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), sum(map(known.__contains__, words)), capitals, text.count("!"),
    )


@functools.cache
def _function_words() -> frozenset[bytes]:
    return frozenset(w.encode() for w in FUNCTION_WORDS)


def counted(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and the counts of every whole text."""

    def run(texts):
        columns = zip(*map(count_text, texts)) if texts else [()] * len(COUNTS)
        return [pa.array(c, pa.int64()) for c in columns]

    return common.map_texts(docs, run, COUNTS, keep, text)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: name: column that votes. Shares are of words, but for lines and letters.
def rules() -> dict[str, Column]:
    symbols, shouts, function = _per("n_symbols", "n_words"), _per("n_shouts", "n_words"), _per("n_function_words", "n_words")
    capitals, lines, repeats, length = _per("n_capitals", "word_chars"), _per("n_dup_lines", "n_lines"), _per("n_repeat_words", "n_words"), _per("word_chars", "n_words")
    return {
        "symbols": _vote(symbols < 0.02, symbols > 0.15),
        "shouts": _vote(shouts < 0.02, shouts > 0.15),
        "capitals": _vote((capitals > 0) & (capitals < 0.08), capitals > 0.3),
        "function_words": _vote(function > 0.12, function < 0.03),
        "line_copies": _vote((F.col("n_lines") > 3) & (lines == 0), lines > 0.3),
        "repeats": _vote((F.col("n_words") > 50) & (repeats < 0.05), repeats > 0.2),
        "word_length": _vote(length.between(3, 9), (length < 2.5) | (length > 12)),
        "size": _vote(F.col("n_words") >= 60, F.col("n_words") < 25),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, dict]:
    """Posterior probability of good for every vote pattern, and what was estimated: `good` share and each rule's accuracies.

    Starts from the majority of votes. A rule that abstains says nothing. Counts are smoothed by one vote each way, and a
    rule is held to be right more often than not in each class, which keeps the two classes from changing names.
    """
    votes = np.array([p for p, _ in patterns], dtype=np.int8)
    weight = np.array([n for _, n in patterns], dtype=float)
    cast, yes = votes != 0, votes > 0
    post = np.clip(yes.sum(1) + 0.5, 0.5, None) / (cast.sum(1) + 1.0)
    post = np.where(votes.sum(1) > 0, np.maximum(post, 0.6), np.minimum(post, 0.4))
    right_good = right_bad = np.zeros(votes.shape[1])
    good = 0.5
    for _ in range(rounds):
        w_good, w_bad = weight * post, weight * (1 - post)
        right_good = np.clip(((w_good[:, None] * (cast & yes)).sum(0) + 1) / ((w_good[:, None] * cast).sum(0) + 2), 0.51, 0.999)
        right_bad = np.clip(((w_bad[:, None] * (cast & ~yes)).sum(0) + 1) / ((w_bad[:, None] * cast).sum(0) + 2), 0.05, 0.999)
        good = float(np.clip(w_good.sum() / weight.sum(), 0.01, 0.99))
        log_good = np.log(good) + np.where(cast, np.where(yes, np.log(right_good), np.log(1 - right_good)), 0).sum(1)
        log_bad = np.log(1 - good) + np.where(cast, np.where(yes, np.log(1 - right_bad), np.log(right_bad)), 0).sum(1)
        new = 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))
        moved = float((weight * np.abs(new - post)).sum() / weight.sum())
        post = new
        if moved < tolerance:
            break
    return post, {"good": good, "right_if_good": right_good.tolist(), "right_if_bad": right_bad.tolist()}


def judge(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, the counts, a vote column per rule, base_failed, p_good and kept."""
    names = list(rules())
    voted = common.written(counted(docs, keep, text).withColumns({f"vote_{n}": c.cast("tinyint") for n, c in rules().items()}), "votes")
    ballot = F.concat_ws(",", *[F.col(f"vote_{n}") for n in names])
    # 3 votes a rule: a table of at most 3 ** rules rows, however many documents there are
    rows = voted.groupBy(ballot.alias("ballot")).agg(F.count("*").alias("n")).orderBy("ballot").collect()
    out = voted.withColumn("base_failed", base_failed())
    if not rows:
        return out.withColumns({"p_good": F.lit(None).cast("double"), "kept": F.lit(False)})
    post, _ = estimate([(tuple(map(int, r.ballot.split(","))), r.n) for r in rows])
    known = dict(zip((r.ballot for r in rows), post.tolist()))
    keys, values = F.split(F.lit(";".join(known)), ";"), F.transform(F.split(F.lit(";".join(map(repr, known.values()))), ";"), lambda x: x.cast("double"))
    table = docs.sparkSession.range(1).select(F.explode(F.arrays_zip(keys.alias("k"), values.alias("v"))).alias("x")).select(F.col("x.k").alias("_ballot"), F.col("x.v").alias("p_good"))
    out = out.withColumn("_ballot", ballot).join(F.broadcast(table), "_ballot").drop("_ballot")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


ship_by_value(__name__)

"""Personal data: patterns of form first, then contexts learnt from them.

E-mail addresses, IP addresses, card and phone numbers that fit their form are found in every whole text. They are the seeds
of a bootstrap: the words around seeds are lexical patterns; every other token with digits or an @ is a candidate; patterns and the
distinct instances they surround make a graph that is scored in turns: a pattern is as sure as the instances it surrounds,
an instance as its patterns together. Candidates in patterns of high confidence, carried by enough different seeds, are
identifiers of the pattern's kind although their form alone does not say so.

Offsets count code points, ends are exclusive. A null text is empty. Spans of the form stay whatever the contexts say. Seeds
are counted as distinct instances, so copies of a document add nothing. Repeated rows get equal results. Extra columns are
only carried by `redact`. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common
from folioworks.shipping import ship_by_value

KINDS = ("email", "ip", "card", "phone")
#: Turns of scoring; what a pattern must reach, and how many different seeds must carry it.
TURNS, CONFIDENCE, SEEDS = 3, 0.8, 4
#: What a pattern's confidence is held back by: instances it would have missed.
PRIOR = 0.5

LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Letters and signs of a candidate.
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._%+-/")
SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
MENTIONS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
SPANS_TYPE = "array<struct<kind:int,start:int,end:int>>"
MENTIONS_TYPE = "array<struct<kind:int,start:int,end:int,instance:string,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


class Forms:
    """Matches of the four forms. A search goes on where the last match ended, and never starts inside a run it has seen fail."""

    def __init__(self):
        import regex

        self.email = regex.compile(rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{DOMAIN}+(?:\.{DOMAIN}+)+")
        self.ip = regex.compile(r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}")
        self.card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
        self.phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
        self.digit = re.compile(r"[0-9]+")
        self.mark = re.compile(r"[0-9@]+")

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(kind, start, end), by kind and start."""
        out = []
        if "@" in text:
            out += [(0, *m.span()) for m in self.email.finditer(text)]
        if not self.digit.search(text):
            return out
        for m in self.ip.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in self.card.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in self.phone.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((3, *m.span()))
        return out

    def candidates(self, text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """Runs of token characters with at least three digits and six characters, or with an @ between others, off the spans."""
        out, end = [], 0
        taken = sorted((s, e) for _, s, e in spans)
        k = 0
        for m in self.mark.finditer(text):
            if m.start() < end:
                continue
            start, end = m.span()
            while start and text[start - 1] in TOKEN:
                start -= 1
            while end < len(text) and text[end] in TOKEN:
                end += 1
            stop = end
            while stop > start and text[stop - 1] in "._%+-/@":
                stop -= 1
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            free = k == len(taken) or taken[k][0] >= stop
            numbered = stop - start >= 6 and sum("0" <= c <= "9" for c in text[start:stop]) > 2
            if free and (numbered or "@" in text[start + 1 : stop]):
                out.append((start, stop))
        return out


class Before:
    """The words before a place of one text, in time that does not grow with the distance to them.

    A short window is enough where words are short; where it holds too few, the text's words are listed once.
    """

    def __init__(self, text: str):
        self.text, self.starts = text, None

    def __call__(self, start: int) -> tuple[list[str], list[str] | None]:
        """The last two words before `start`, the near end of each, and those on its line if they are fewer than two."""
        size = 60
        while size <= 960:
            before = self.text[max(0, start - size) : start]
            words = before.split()
            if len(words) > 2 or size >= start:  # the first word may be cut, so one more than needed
                line = before.rsplit("\n", 1)[-1].split() if "\n" in before or size >= start else None
                return [w.lower()[-60:] for w in words[-2:]], [w.lower()[-60:] for w in line] if line is not None and len(line) < 2 else None
            size *= 4
        return self._listed(start)

    def _listed(self, start: int) -> tuple[list[str], list[str] | None]:
        if self.starts is None:
            self.starts, self.ends, self.first = array("q"), array("q"), bytearray()
            end = 0
            for m in re.finditer(r"\S+", self.text):
                self.first.append(not end or "\n" in self.text[end : m.start()])
                end = m.end()
                self.starts.append(m.start())
                self.ends.append(end)
        n = bisect_left(self.starts, start)  # words that begin before
        near = [self.text[max(self.starts[i], e - 61) : e].lower()[-60:] for i in range(max(0, n - 2), n) for e in [min(self.ends[i], start)]]
        inside = bool(n) and self.ends[n - 1] > start
        own = (n - 1 if inside or n == len(self.starts) else n)  # the word at `start`
        if own < n:  # glued to what stands before it
            return near, near[-1:] if self.first[own] else None
        if self.first[own]:
            return near, []
        return near, near[-1:] if self.first[own - 1] else None


def contexts(text: str, start: int, end: int, words_before: Before | None = None) -> list[str]:
    """Lexical patterns around a span: the two words before it, the word before with the word after, each of the two alone,
    and the word that alone stands before it on its line. Digits are all 0; of words over 60 characters the near end counts."""
    left, line = (words_before or Before(text))(start)
    glued = "" if not start or text[start - 1].isspace() else "<"
    after = text[end : end + 60].split()
    right = after[0].lower().strip(".,;:!?") if after and end < len(text) and text[end].isspace() else ""
    out = []
    if len(left) > 1:
        out.append(f"L {left[0]} {left[1]}{glued}")
    if left:
        out.append(f"W {left[-1]}{glued}")
    if left and right:
        out.append(f"B {left[-1]}{glued} _ {right}")
    if right:
        out.append(f"R {right}")
    if line is not None:
        out.append(f"S {line[0] if line else ''}{glued}")
    return ["".join("0" if "0" <= c <= "9" else c for c in p) for p in out]


def found_by_form(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, spans of the four forms, and mentions: seeds (with a kind) and candidates (without) in their patterns."""

    def run(texts):
        forms, spans, mentions = Forms(), [], []
        for t in texts:
            t = t or ""
            got = forms.spans(t)
            seen = [(k, s, e) for k, s, e in got] + [(None, s, e) for s, e in forms.candidates(t, got)]
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in got])
            before = Before(t)
            mentions.append([{"kind": k, "start": s, "end": e, "instance": t[s:e].lower(), "patterns": contexts(t, s, e, before)} for k, s, e in seen])
        return [pa.array(spans, SPANS), pa.array(mentions, MENTIONS)]

    return common.map_texts(docs, run, [("base", SPANS_TYPE), ("mentions", MENTIONS_TYPE)], keep, text)


def score_patterns(edges: DataFrame, turns: int = TURNS, confidence: float = CONFIDENCE, seeds: int = SEEDS) -> DataFrame:
    """(pattern, kind, confidence) of the patterns to trust. `edges` (pattern, instance, kind) are distinct and written.

    A seed counts for its kind alone. Each turn sums over the graph's edges; sums are formed in part before they are shuffled,
    and patterns or instances with any share of the edges are joined as hot keys.
    """
    kinds = edges.groupBy("instance").agg(F.max("kind").alias("kind"), F.count("*").alias("n"))
    known = common.written(kinds.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("score"), "n"), "instances")
    degree = common.written(edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n")), "degrees")
    slim = common.written(edges.select("pattern", "instance").distinct(), "edges")
    scores, seeds_only = known, known
    patterns = None
    for turn in range(turns):
        at = common.hot_join(slim, scores, "instance")
        sums = at.groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        patterns = sums.join(degree, "pattern").withColumn("confidence", F.col("mass") / (F.col("n") + PRIOR))
        patterns = common.written(patterns.where(F.col("confidence") >= 0.5), "patterns")
        if turn + 1 < turns:
            told = common.hot_join(slim, patterns.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("b"), F.max("n").alias("n")), "pattern")
            other = told.groupBy("instance", F.col("b.kind").alias("kind")).agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("b.confidence"), F.lit(0.999)))))).alias("score"))
            best = other.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b")).join(seeds_only.select("instance"), "instance", "left_anti")
            counts = kinds.where("kind is null").select("instance", "n")
            new = best.join(counts, "instance").select("instance", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"), "n")
            scores = common.written(seeds_only.unionByName(new), "instances")
    carried = common.hot_join(slim, seeds_only, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    return patterns.join(carried, ["pattern", "kind"]).where((F.col("confidence") >= confidence) & (F.col("seeds") >= seeds)).select("pattern", "kind", "confidence")


def found_by_context(rows: DataFrame) -> DataFrame:
    """(k1, k2, found): per text, spans of candidates in trusted patterns. `rows` has k1, k2 and mentions and is written."""
    each = rows.select("k1", "k2", F.explode("mentions").alias("m")).select("k1", "k2", "m.*").where(F.size("patterns") > 0)
    edges = common.written(each.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct(), "edges")
    trusted = common.written(score_patterns(edges), "trusted")
    open_ = common.written(each.where("kind is null").select("k1", "k2", "start", "end", F.explode("patterns").alias("pattern")), "candidates")
    counts = open_.groupBy("pattern").agg(F.count("*").alias("n"))
    hits = common.hot_join(open_, trusted.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("b")).join(counts, "pattern"), "pattern")
    best = hits.groupBy("k1", "k2", "start", "end").agg(F.max("b").alias("b"))
    return best.groupBy("k1", "k2").agg(F.collect_list(F.struct(F.col("b.kind").alias("kind"), "start", "end")).alias("found"))


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, base (spans by form) and spans (all), both by kind and start."""
    k1, k2 = common.text_key(F.col("doc_id"), F.col(text))
    src = docs.select(*dict.fromkeys([*keep, "doc_id", text])).withColumns({"k1": k1, "k2": k2})
    rows = common.written(found_by_form(src, [*keep, "k1", "k2"], text), "mentions")
    found = common.written(found_by_context(rows), "found")
    out = rows.join(found, ["k1", "k2"], "left")
    return out.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("found", F.array().cast(SPANS_TYPE))))).drop("mentions", "found")


def spelt(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def count_of(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, each span of the text replaced by its kind in brackets; overlapping spans are replaced as one, by the first's kind."""
    k1, k2 = common.text_key(F.col("doc_id"), F.col(text))
    spans = find(docs, ["doc_id"], text).where(F.size("spans") > 0).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "spans").dropDuplicates(["_k1", "_k2"])
    keyed = docs.withColumns({"_k1": k1, "_k2": k2}).join(common.written(spans, "spans"), ["_k1", "_k2"], "left")

    start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def put(acc, s):
        clear = s["start"] >= acc["at"]
        more = F.concat(acc["done"], F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), names[s["kind"]])
        return F.struct(F.when(clear, more).otherwise(acc["done"]).alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(start, zero, put, lambda acc: F.concat(acc["done"], F.substr(F.col(text), acc["at"] + 1)))
    return keyed.withColumn(text, F.when(F.col("spans").isNull(), F.col(text)).otherwise(done)).select(*docs.columns)


ship_by_value(__name__)

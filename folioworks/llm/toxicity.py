"""Toxicity of deobfuscated text by a noisy channel.

Spans that look disguised (digits and signs in words, letters drawn out, letters set apart) become character lattices:
a sign may stand for one of several letters, a run of a letter for one or two of it, a blank or dash between single letters
for nothing. A character trigram model, counted over all documents, decides by Viterbi search which reading was meant. The
readings are scored together with the text as it stands. A sign that only stands in a text when the pieces of a broken word
are put together counts if the same model would rather have them as one word.

The score comes from words and word beginnings that labelled documents show to be toxic. First they are chosen one after
another, each the one that best separates toxic from clean among the documents no earlier one explains; then all others are
added whose own evidence is as strong. All stand in several different places. So words that merely occur in copies of one
toxic document are not taken; near copies are also counted once, before anything is sampled. Learning reads at most SAMPLE
different labelled documents a class, those of smallest hash; counts for the character model cover all documents; scoring reads every whole text.

Null and empty texts get the score of a text without any sign of toxicity. Labels that are null or belong to no document are
ignored; of several labels for one document the highest counts. Without toxic labels every score is the smoothed base rate.
Repeated rows get equal scores. Only the columns named in `keep` are carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common
from folioworks.llm.neardup import Signer, shingles
from folioworks.shipping import ship_by_value

#: Labelled documents of each class that are learnt from, at most.
SAMPLE = 10_000
#: Bands of minima by which near copies are told: a pair of similarity 0.8 shares one with a probability of 0.998.
COPY_BANDS = 16
#: Letters of the word beginnings that may be signs.
BEGINNINGS = (4, 5, 6, 7)
#: A sign is toxic only if this part of the documents that hold it is.
SURE = 0.7
#: And only if it stands in so many different places; the number does not grow with the documents.
PLACES = 3
THRESHOLD = 0.3

#: Letters the character model tells apart, besides "no letter" (0) and "another letter" (the last). Fixed values.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß"
ALPHABET = len(LETTERS) + 2
#: What a sign may stand for. Fixed values.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou", "#": "h", "(": "c",
}
SIGNS = re.escape("".join(STANDS_FOR))
#: Nats that a channel step costs.
AS_SIGN, AS_RUN, DROPPED, KEPT_APART = 0.7, 0.2, 0.1, 1.5
#: Nats by which a word must be likelier than its pieces, for each place where it is broken.
BROKEN = 4.0

_LETTER = r"[^\W\d_]"
WORD = re.compile(rf"{_LETTER}+")
_DRAWN = rf"(?:{_LETTER}|\d|[{SIGNS}])"
#: Runs of letters, digits and signs, wherever they stand, with a letter and something else.
MIXED = re.compile(rf"(?<!{_LETTER})(?<![\d{SIGNS}])(?:[\d{SIGNS}]+{_LETTER}|{_LETTER}+[\d{SIGNS}]){_DRAWN}*")
#: Signs that also end a sentence, a quotation or a remark: a word is read without those behind it, too.
ENDS = "!|*+("
THRICE = re.compile(rf"({_LETTER})\1\1")
#: What may stand between letters set apart, and where a word is broken.
APART = " \t\n\r._*~,;:/'-"
_APART = re.escape(APART)
SET_APART = re.compile(rf"(?<![^\W_])[^\W_](?:[{_APART}]{{1,3}}(?:[^\W_]|[@$!|])(?![^\W_])){{2,}}")
BREAK = re.compile(rf"(?<={_LETTER})[{_APART}]{{1,3}}(?={_LETTER})")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


# The character model.


def letter_codes() -> np.ndarray:
    """Alphabet index of every code point below U+10000."""
    out = np.zeros(0x10000, dtype=np.int64)
    for cp in range(0x10000):
        if chr(cp).isalpha():
            out[cp] = ALPHABET - 1
    for i, c in enumerate(LETTERS):
        out[ord(c)] = i + 1
    return out


def character_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n): trigrams of letters over all whole texts, summed in each task before they are shuffled."""

    def run(batches):
        codes, total = letter_codes(), np.zeros(ALPHABET**3, dtype=np.int64)

        def add(texts):
            cps = np.frombuffer(" ".join(["", *texts, ""]).lower().encode("utf-32-le"), dtype="<u4")
            x = codes[np.where(cps < 0x10000, cps, 0)]
            if len(x) > 2:
                total[:] += np.bincount((x[:-2] * ALPHABET + x[1:-1]) * ALPHABET + x[2:], minlength=len(total))

        for b in batches:
            some, size = [], 0
            for t in b.column(0).to_pylist():
                if t:
                    some.append(t)
                    size += len(t)
                if size > 1_000_000:
                    add(some)
                    some, size = [], 0
            add(some)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
    return docs.select(text).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def character_model(counts: list[tuple[int, int]], weight: float = 5.0) -> np.ndarray:
    """log p(c | a, b) at [a, b, c], each order smoothed by the one below."""
    c3 = np.zeros(ALPHABET**3)
    for code, n in counts:
        c3[code] = n
    c3 = c3.reshape(ALPHABET, ALPHABET, ALPHABET)
    c2 = c3.sum(0)
    c1 = c2.sum(0)
    p1 = (c1 + 1) / (c1.sum() + ALPHABET)
    p2 = (c2 + weight * p1) / (c2.sum(1, keepdims=True) + weight)
    p3 = (c3 + weight * p2) / (c3.sum(2, keepdims=True) + weight)
    return np.log(p3).astype(np.float32)


# The lattice.


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For every step through the span, what it may read as, and the cost."""
    apart = SET_APART.fullmatch(span) is not None
    steps, i = [], 0
    while i < len(span):
        c, j = span[i], i + 1
        while j < len(span) and span[j] == c and (c.isalpha() or c in STANDS_FOR):
            j += 1
        if c.isalpha():
            once = [(c, AS_RUN), (c + c, AS_RUN)] if j - i > 2 else [(c * (j - i), 0.0)]
            steps.append(once)
        elif apart and c in APART:
            steps.append([("", DROPPED), (" ", KEPT_APART)])
            j = i + 1
        elif c in STANDS_FOR:
            letters = STANDS_FOR[c]
            n = min(j - i, 2)
            steps.append([(x * k, AS_SIGN + AS_RUN * (k != j - i)) for x in letters for k in range(1, n + 1)] + [(" ", KEPT_APART)])
        else:
            steps.append([(" ", 0.0)])
        i = j
    return steps


def readings(span: str, model: np.ndarray, index: dict[str, int], most: int = 3) -> list[str]:
    """The best readings of a span: Viterbi over the last two letters, two survivors a state."""
    other, start = ALPHABET - 1, (0.0, None, "")
    states = {(0, 0): [start]}  # survivors: score, the survivor before, what was said
    for step in [*lattice(span), [(" ", 0.0)]]:
        after: dict[tuple[int, int], list[tuple]] = {}
        for (a, b), found in states.items():
            for said, cost in step:
                x, y, lp = a, b, -cost
                for c in said:
                    z = index.get(c, other if c.isalpha() else 0)
                    lp += float(model[x, y, z])
                    x, y = y, z
                after.setdefault((x, y), []).extend((f[0] + lp, f, said) for f in found)
        states = {k: sorted(v, key=lambda f: -f[0])[:2] for k, v in after.items()}
    best = sorted((f for v in states.values() for f in v), key=lambda f: -f[0])[:most]
    out = []
    for f in best:
        said = []
        while f[1] is not None:
            said.append(f[2])
            f = f[1]
        out.append("".join(reversed(said)).strip())
    return out


def drawn_out(low: str):
    """Words with a letter three times or more in a row."""
    end = 0
    for m in THRICE.finditer(low):
        if m.start() >= end:
            start, end = m.span()
            while start and low[start - 1].isalpha():
                start -= 1
            while end < len(low) and low[end].isalpha():
                end += 1
            yield low[start:end]


def mixed(low: str):
    """Runs of letters and signs; one with ENDS behind it also without them, and not with them if a plain word is left."""
    for m in MIXED.finditer(low):
        core = m[0].rstrip(ENDS)
        if not core.isalpha():
            yield core
            if core != m[0]:
                yield m[0]
        elif m[0][len(core)] != "!":
            yield m[0]


class Reader:
    """Lower-case texts, and the readings of their disguised spans."""

    def __init__(self, model: np.ndarray):
        self.model, self.known, self.broken = model, {}, {}
        self.index = {c: i + 1 for i, c in enumerate(LETTERS)}

    def read(self, text: str | None) -> tuple[str, str]:
        """The text in lower case, and all readings, a line each."""
        low = (text or "").lower()
        spans = [*mixed(low), *(m[0] for m in SET_APART.finditer(low)), *drawn_out(low)]
        out = []
        for s in dict.fromkeys(spans):
            if not any(c.isalpha() for c in s):
                continue
            got = self.known.get(s)
            if got is None:
                got = readings(s, self.model, self.index)
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[s] = got
            out += got
        return low, "\n".join(out)


    def likely(self, text: str) -> float:
        """log p of the letters and blanks of a text."""
        a = b = 0
        total = 0.0
        for c in text + " ":
            z = self.index.get(c, ALPHABET - 1 if c.isalpha() else 0)
            total += float(self.model[a, b, z])
            a, b = b, z
        return total

    def is_one_word(self, pieces: list[str]) -> bool:
        """Whether the character model would rather have the pieces as one word."""
        key = tuple(pieces)
        if key not in self.broken:
            if len(self.broken) > 100_000:
                self.broken.clear()
            self.broken[key] = self.likely("".join(pieces)) - self.likely(" ".join(pieces)) > BROKEN * (len(pieces) - 1)
        return self.broken[key]


# What is toxic.


@dataclass(frozen=True)
class Toxicity:
    """The character model, and the signs with their probabilities: a beginning as it is, a whole word with a blank behind it."""

    characters: np.ndarray
    signs: dict[str, float]
    base: float


def different(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, key, toxic), written: labelled documents that may be learnt from, near copies within a class counted once.

    Texts that share a band of five independent minima of their five-word shingles are copies; the smallest doc_id stays.
    Of every text only its bands are shuffled.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    def run(texts):
        signer, out = Signer(), []
        for t in texts:
            found = shingles(t, 5)
            out.append(signer.sign(found)[0][:COPY_BANDS] if len(found) else [0])  # texts without words are copies of each other
        return [pa.array(out, pa.list_(pa.int64()))]

    bands = common.map_texts(keyed(docs), run, [("bands", "array<bigint>")], ["doc_id", "key"])
    rows = common.written(bands.join(known, "doc_id").dropDuplicates(["doc_id", "key"]), "toxicity-bands")
    one = F.struct("doc_id", "key")
    each = common.written(rows.select(one.alias("one"), F.explode("bands").alias("band"), "toxic").select("one", F.xxhash64("toxic", "band").alias("band")), "toxicity-each")
    shared = each.groupBy("band").agg(F.min("one").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = common.hot_join(each, common.written(shared, "toxicity-shared"), "band").where(F.col("one") > F.col("first")).select("one.*").distinct()
    return common.written(rows.join(copies, ["doc_id", "key"], "left_anti").select("doc_id", "key", "toxic"), "toxicity-different")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): the key tells different texts of one doc_id apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("key"))


def sample(docs: DataFrame, known: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the `different` documents: per class the `size` of smallest hash, so it can be broadcast."""
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(size) for k in (1, 0)]
    some = common.written(parts[0].unionByName(parts[1]), "toxicity-sample")
    texts = keyed(docs).join(F.broadcast(some), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
    return common.written(texts.select("text", "toxic"), "toxicity-texts")


def signs_of(low: str) -> set[str]:
    """Words (with a blank behind) and word beginnings of a lower-case text."""
    words = set(WORD.findall(low))
    return {w + " " for w in words} | {w[:n] for w in words for n in BEGINNINGS if len(w) >= n}


def sign_counts(texts: DataFrame, model: np.ndarray) -> DataFrame:
    """(sign, toxic, clean): documents of each class that hold a sign, summed in each task before they are shuffled."""
    characters = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader = Reader(characters.value)
        counts = (Counter(), Counter())

        def flush():
            names = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in (counts[1], counts[0]))], names=["sign", "toxic", "clean"])
            for c in counts:
                c.clear()

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[int(toxic > 0)].update(signs_of("\n".join(reader.read(text))))
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield from flush()
        yield from flush()

    return texts.select("text", "toxic").mapInArrow(run, "sign string, toxic long, clean long").groupBy("sign").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Finder:
    """Signs of a text, found in one pass over its characters."""

    def __init__(self, signs: list[str]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[int, bool]]] = {}
        for i, s in enumerate(signs):
            by_text.setdefault(s.rstrip(" "), []).append((i, s.endswith(" ")))
        for s, which in by_text.items():
            self.machine.add_word(s, (len(s), which))
        if by_text:
            self.machine.make_automaton()
        self.any = bool(by_text)
        self.kept = np.array([chr(c) not in APART for c in range(129)])

    def find(self, low: str) -> dict[int, str]:
        """Signs, each with what stands before it where it first occurs."""
        out: dict[int, str] = {}
        for end, (n, which) in self.machine.iter(low) if self.any else ():
            start = end - n + 1
            if start and low[start - 1].isalpha():
                continue
            closed = end + 1 == len(low) or not low[end + 1].isalpha()
            for i, whole in which:
                if (closed or not whole) and i not in out:
                    out[i] = low[max(0, start - 10) : start]
        return out


    def find_broken(self, low: str, reader: Reader) -> dict[int, str]:
        """Signs in words that are broken where the character model would rather have them whole."""
        out: dict[int, str] = {}
        if not self.any or not low:
            return out
        cps = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kept = self.kept[np.minimum(cps, 128)]
        where = np.flatnonzero(kept)
        for end, (n, which) in self.machine.iter(cps[kept].tobytes().decode("utf-32-le", "surrogatepass")):
            start, stop = int(where[end - n + 1]), int(where[end]) + 1
            if stop - start == n or (start and low[start - 1].isalpha()):
                continue
            closed = stop == len(low) or not low[stop].isalpha()
            while stop < len(low) and low[stop].isalpha():
                stop += 1
            new = [i for i, whole in which if (closed or not whole) and i not in out]
            pieces = BREAK.split(low[start:stop]) if new else []
            if new and all(map(str.isalpha, pieces)) and reader.is_one_word(pieces):
                out |= dict.fromkeys(new, low[max(0, start - 10) : start])
        return out


def _evidence(toxic: float, clean: float, rate: float) -> float:
    """Log-likelihood ratio of a sign's documents against the base rate; below 0 for signs of the clean class."""
    n = toxic + clean
    p = toxic / n if n else 0.0
    if p <= rate:
        return -1.0
    return toxic * math.log(p / rate) + (clean * math.log((1 - p) / (1 - rate)) if clean else 0.0)


def _evidences(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    """`_evidence` of many signs."""
    n = toxic + clean
    p = np.divide(toxic, n, out=np.zeros(len(n)), where=n > 0)
    up = p > rate
    out = np.full(len(n), -1.0)
    out[up] = toxic[up] * np.log(p[up] / rate)
    both = up & (clean > 0)
    out[both] += clean[both] * np.log((1 - p[both]) / (1 - rate))
    return out


def choose(signs: list[str], held: list[dict[int, str]], toxic: list[bool], weight: tuple[float, float], least: float) -> tuple[dict[str, float], float]:
    """Signs with their probabilities, and the probability of a document without any.

    `held` has each document's signs with what stands before them; `weight` is what a clean and a toxic document of the
    sample stand for. No sign is chosen whose evidence is under `least`.
    """
    docs_of: list[list[int]] = [[] for _ in signs]
    for d, found in enumerate(held):
        for i in found:
            docs_of[i].append(d)
    count = np.zeros((2, len(signs)))
    for i, ds in enumerate(docs_of):
        for d in ds:
            count[int(toxic[d]), i] += 1
    total, open_docs, chosen = count.copy(), np.ones(len(held), dtype=bool), {}
    sure = (weight[1] * total[1] + 0.5) / (weight[1] * total[1] + weight[0] * total[0] + 1)
    befores = [[held[d][i] for d in ds if toxic[d]] for i, ds in enumerate(docs_of)]
    varied = [i for i, b in enumerate(befores) if len(set(filter(None, b))) + b.count("") >= PLACES]  # each text's start is a place
    left = [float(len(toxic) - sum(toxic)), float(sum(toxic))]
    ranked = np.array(sorted(varied, key=lambda i: (len(signs[i]), signs[i]), reverse=True), dtype=np.int64)  # ties go to the first
    while len(ranked) and left[1] > 0:
        rate = weight[1] * left[1] / (weight[1] * left[1] + weight[0] * left[0])
        scores = np.where(count[1, ranked] > 2, _evidences(count[1, ranked] * weight[1], count[0, ranked] * weight[0], rate) / max(weight[1], 1.0), -1.0)
        best = int(scores.argmax())
        if scores[best] < least:
            break
        i = int(ranked[best])
        chosen[signs[i]] = float(sure[i])
        for d in docs_of[i]:
            if open_docs[d]:
                open_docs[d] = False
                left[int(toxic[d])] -= 1
                for k in held[d]:
                    count[int(toxic[d]), k] -= 1
    rate = weight[1] * sum(toxic) / (weight[1] * sum(toxic) + weight[0] * (len(toxic) - sum(toxic)))
    at = {s: i for i, s in enumerate(signs)}
    own = _evidences(total[1], total[0] * weight[0] / weight[1], rate)
    longer: dict[str, list[str]] = {}  # chosen signs by what they begin with
    for c in chosen:
        for n in range(1, len(c) + 1):
            longer.setdefault(c[:n], []).append(c)
    for s in sorted((signs[i] for i in varied), key=lambda s: (-own[at[s]], not s.endswith(" "), -len(s), s)):
        if any(s[:n] in chosen for n in range(1, len(s) + 1)):
            continue
        known = {d for c in longer.get(s, ()) for d in docs_of[at[c]]}
        more = [d for d in docs_of[at[s]] if d not in known]  # what it finds beyond longer signs that begin with it
        bad = [d for d in more if toxic[d]]
        if len(bad) > 2 and _evidence(len(bad), (len(more) - len(bad)) * weight[0] / weight[1], rate) >= least:
            chosen[s] = float(sure[at[s]])
            for n in range(1, len(s) + 1):
                longer.setdefault(s[:n], []).append(s)
    base = (weight[1] * left[1] + 0.5) / (weight[1] * left[1] + weight[0] * left[0] + 1)
    return chosen, min(base, 0.25)


def learn(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """The model of a corpus and its labels. The driver sees trigram counts (a fixed alphabet) and the signs of the sample, which SAMPLE bounds."""
    characters = character_model([tuple(r) for r in character_counts(docs).collect()])
    known = different(docs, labels)
    texts = sample(docs, known)
    sizes = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    all_of = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1):
        return Toxicity(characters, {}, 0.5 / (sizes.get(0, 0) + 1))
    weight = (max(1.0, all_of[0] / sizes[0]) if sizes.get(0) else 1.0, max(1.0, all_of[1] / sizes[1]))
    counts = common.written(sign_counts(texts, characters), "toxicity-signs")
    tested = counts.where("toxic > 2").count()
    least = math.log(2 * max(tested, 1))  # a sign that chance gives in one of two corpora
    n = F.col("toxic") * weight[1] + F.col("clean") * weight[0]
    p = F.col("toxic") * weight[1] / n
    likely = counts.where((F.col("toxic") > 2) & (p > SURE))
    signs = sorted(r.sign for r in likely.select("sign").collect())
    reader_model, names = texts.sparkSession.sparkContext.broadcast(characters), signs

    def run(batches):
        reader, finder = Reader(reader_model.value), Finder(names)
        for b in batches:
            found = [finder.find("\n".join(reader.read(t))) for t in b.column(0).to_pylist()]
            arrays = [pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*arrays, b.column(1).cast(pa.int64())], names=["found", "places", "toxic"])

    rows = texts.select("text", "toxic").mapInArrow(run, "found array<int>, places array<string>, toxic long").collect()
    held, toxic = [dict(zip(r.found, r.places)) for r in rows], [r.toxic > 0 for r in rows]
    chosen, base = choose(signs, held, toxic, weight, least)
    return Toxicity(characters, chosen, base)


def score(docs: DataFrame, model: Toxicity, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, score (probability of a toxic label) and n_signs of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.characters, model.signs, model.base))

    def run(texts):
        characters, signs, base = sent.value
        reader, names = Reader(characters), list(signs)
        finder, clean = Finder(names), [math.log1p(-min(signs[s], 0.999999)) for s in names]
        scores, numbers = [], []
        for t in texts:
            low, read = reader.read(t)
            found = finder.find(low)
            found = {**finder.find_broken(low, reader), **(finder.find(read) if read else {}), **found}
            scores.append(1 - math.exp(sum(clean[i] for i in found)) if found else base)
            numbers.append(len(found))
        return [pa.array(scores, pa.float64()), pa.array(numbers, pa.int64())]

    return common.map_texts(docs, run, [("score", "double"), ("n_signs", "bigint")], keep, text)


ship_by_value(__name__)

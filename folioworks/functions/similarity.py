"""Similarity of texts: indel ratio, best-window ratio and token-set ratio.

Spark has Levenshtein built in but neither the longest-common-subsequence ratio nor a best-window
ratio, so those two are Arrow-batched functions over numpy. Every scorer first drops pairs that
cannot reach the cutoff (length and character-set bounds), then scores the rest bit-parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.shipping import ship_by_value

ship_by_value(__name__)

_ONE = np.uint64(1)


def _codes(texts: list[str], width: int) -> np.ndarray:
    flat = "".join([t.ljust(width, "\0") for t in texts])
    return np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32).reshape(len(texts), width).copy()


def _lcs_long(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _places(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(row of each text, bits of the places of every ASCII letter, row by row); None where other letters or zeros stand."""
    known: dict[str, int] = {}
    row = np.array([known.setdefault(t, len(known)) for t in texts], dtype=np.int64)
    codes = _codes(list(known), width)
    lens = np.array([len(t) for t in known])
    if codes.max(initial=0) > 127 or np.count_nonzero(codes) != lens.sum():
        return None
    bits = np.zeros((len(known), 128), dtype=np.uint64)
    for j in range(width):
        on = np.flatnonzero(lens > j)
        bits[on, codes[on, j]] |= _ONE << np.uint64(j)
    return row * 128, bits.ravel()


def lcs_lengths(a: list[str], b: list[str], block: int = 8192) -> np.ndarray:
    """Longest common subsequence length of each pair, vectorized across pairs."""
    swap = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    out = np.zeros(len(swap), dtype=np.int64)
    short = np.array([i for i, (x, _) in enumerate(swap) if len(x) <= 64], dtype=np.int64)
    for i, (x, y) in enumerate(swap):
        if len(x) > 64:
            out[i] = _lcs_long(x, y)
    if len(short) == 0:
        return out
    short = short[np.argsort([len(swap[i][1]) for i in short], kind="stable")]
    for lo in range(0, len(short), block):
        idx = short[lo : lo + block]
        xs, ys = [swap[i][0] for i in idx], [swap[i][1] for i in idx]
        wx, wy = max(map(len, xs), default=0), max(map(len, ys), default=0)
        if wx == 0:
            continue
        ay = _codes(ys, wy)
        state = np.full(len(idx), ~np.uint64(0))
        places = _places(xs, wx) if ay.max(initial=0) <= 127 else None
        if places is not None:
            row, bits = places
            at = ay.T.astype(np.int64) + row
            for j in range(wy):
                hit = state & bits[at[j]]
                state = (state + hit) | (state - hit)
        else:
            span = 8 * -(-wx // 8)
            ax = _codes(xs, span)
            # a zero may be a letter: only what stands behind a text's end is made to match nothing
            ax[np.arange(span) >= np.array([len(x) for x in xs])[:, None]] = 0xFFFFFFFF
            ay[np.arange(wy) >= np.array([len(y) for y in ys])[:, None]] = 0xFFFFFFFE
            match = np.zeros((len(idx), 8), dtype=np.uint8)
            for j in range(wy):
                match[:, : span // 8] = np.packbits(ax == ay[:, j : j + 1], axis=1, bitorder="little")
                hit = state & match.view(np.uint64)[:, 0]
                state = (state + hit) | (state - hit)
        lens = np.array([len(x) for x in xs], dtype=np.uint64)
        keep = np.where(lens >= 64, ~np.uint64(0), (_ONE << np.minimum(lens, np.uint64(63))) - _ONE)
        out[idx] = lens.astype(np.int64) - np.bitwise_count(state & keep).astype(np.int64)
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """200 * LCS / (len a + len b); two empty texts score 100."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], dtype=np.float64)
    lcs = lcs_lengths(a, b)
    return np.where(total == 0, 100.0, 200.0 * lcs / np.where(total == 0, 1, total))


def _sets(texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, t in enumerate(texts):
        m = 0
        for ch in set(t):
            m |= 1 << (ord(ch) & 63)
        out[i] = m
    return out


def pairs_over(texts: list[str], entries: list[str], cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, entry index, score) of every pair whose ratio reaches the cutoff."""
    lt = np.array([len(t) for t in texts], dtype=np.float64)[:, None]
    le = np.array([len(e) for e in entries], dtype=np.float64)[None, :]
    budget = (lt + le) * (1.0 - cutoff / 100.0) + 1e-9
    apart = np.bitwise_count(_sets(texts)[:, None] ^ _sets(entries)[None, :])
    ti, ei = np.nonzero((np.abs(lt - le) <= budget) & (apart <= budget) & (lt > 0))
    if len(ti) == 0:
        return ti, ei, np.zeros(0)
    score = ratios([texts[i] for i in ti], [entries[j] for j in ei])
    ok = score >= cutoff
    return ti[ok], ei[ok], score[ok]


def _pieces(phrase: str, cutoff: float) -> list[tuple[int, str]]:
    """Cut a phrase into one more piece than the edits the cutoff allows: one piece must survive whole."""
    edits = int(2 * len(phrase) * (1.0 - cutoff / 100.0) + 1e-9)
    n = min(edits + 1, len(phrase))
    bounds = [round(k * len(phrase) / n) for k in range(n + 1)]
    return [(bounds[k], phrase[bounds[k] : bounds[k + 1]]) for k in range(n)]


def _edits(phrase: str, cutoff: float) -> int:
    """Insertions and deletions a window no longer than the phrase may need and still reach the cutoff."""
    return int(2 * len(phrase) * (1.0 - cutoff / 100.0) + 1e-9)


class _Grams:
    """Which phrases may be near a text: every edit spoils at most q of a phrase's q-grams, so enough must be left."""

    def __init__(self, phrases: list[str], cutoff: float):
        self.sizes: set[int] = set()
        self.need: list[tuple[int, int]] = []
        self.index: dict[str, list[tuple[int, int]]] = {}
        for k, ph in enumerate(phrases):
            bounds = {q: len(ph) - q + 1 - q * _edits(ph, cutoff) for q in (3, 2, 1) if len(ph) >= q}
            q = next((q for q, v in bounds.items() if v > 2), next((q for q, v in sorted(bounds.items()) if v > 1), 1))
            self.sizes.add(q)
            self.need.append((q, max(1, bounds[q])))
            counts: dict[str, int] = {}
            for i in range(len(ph) - q + 1):
                counts[ph[i : i + q]] = counts.get(ph[i : i + q], 0) + 1
            for g, n in counts.items():
                self.index.setdefault(g, []).append((k, n))
        self.known = frozenset(self.index)

    def near(self, text: str) -> list[int]:
        seen: dict[int, int] = {}
        for q in self.sizes:
            # a gram of q letters is held for phrases of that q only
            for g in self.known.intersection({text[i : i + q] for i in range(len(text) - q + 1)}):
                for k, n in self.index[g]:
                    seen[k] = seen.get(k, 0) + n
        return [k for k, n in seen.items() if n >= self.need[k][1]]


def _windows(phrase: str, text: str, cutoff: float, pieces: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """Stretches of a text around a surviving piece of the phrase, each as long as the phrase (less at the ends)."""
    m, edits = len(phrase), _edits(phrase, cutoff)
    starts: set[int] = set()
    for offset, piece in pieces:
        p = text.find(piece)
        while p >= 0:
            starts.update(range(p - offset - edits, p - offset + edits + 1))
            p = text.find(piece, p + 1)
    spans = {(max(0, s), min(len(text), s + m)) for s in starts if s < len(text) and s + m > 0}
    return sorted((s, e) for s, e in spans if e > s)


def best_windows(pairs: list[tuple[str, str]], cutoff: float) -> list[tuple[float, int, int] | None]:
    """For each (phrase, text) the best window of the text, when it reaches the cutoff: (score, start, stop).

    A text shorter than its phrase is compared whole. All windows of the batch are scored together.
    """
    out: list[tuple[float, int, int] | None] = [None] * len(pairs)
    owner: list[tuple[int, int, int]] = []
    left: list[str] = []
    right: list[str] = []
    todo = []
    for i, (phrase, text) in enumerate(pairs):
        at = text.find(phrase) if phrase else -1
        if at >= 0:
            out[i] = (100.0, at, at + len(phrase))
        elif phrase and text:
            todo.append(i)
    # no window can share more with the phrase than the whole text does
    short = [i for i in todo if len(pairs[i][1]) <= 4 * len(pairs[i][0])]
    shared = lcs_lengths([pairs[i][0] for i in short], [pairs[i][1] for i in short])
    hopeless = {i for i, n in zip(short, shared.tolist()) if n < cutoff * len(pairs[i][0]) / (200.0 - cutoff) - 1e-9}
    pieces: dict[str, list[tuple[int, str]]] = {}
    for i in todo:
        if i in hopeless:
            continue
        phrase, text = pairs[i]
        if phrase not in pieces:
            pieces[phrase] = _pieces(phrase, cutoff)
        spans = [(0, len(text))] if len(text) < len(phrase) else _windows(phrase, text, cutoff, pieces[phrase])
        for s, e in spans:
            owner.append((i, s, e))
            left.append(phrase)
            right.append(text[s:e])
    if left:
        for (i, s, e), score in zip(owner, ratios(left, right).tolist()):
            if score >= cutoff and (out[i] is None or score > out[i][0]):
                out[i] = (score, s, e)
    return out


def best_window(phrase: str, text: str, cutoff: float) -> tuple[float, int, int] | None:
    return best_windows([(phrase, text)], cutoff)[0]


def _indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    ok = a.notna() & b.notna()
    out = pd.Series(np.nan, index=a.index)
    if ok.any():
        out[ok] = ratios(a[ok].tolist(), b[ok].tolist())
    return out.where(ok, None)


def _once(f, kind):
    """A function whose filters are not pushed below it or below a shuffle, where it would be run a second time."""
    return F.pandas_udf(f, kind).asNondeterministic()


indel_ratio = F.pandas_udf(_indel_ratio, T.DoubleType())
#: The same for scores that are filtered and kept.
indel_ratio_once = _once(_indel_ratio, T.DoubleType())


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best-window ratio of the shorter text inside the longer one (0 when below 1)."""

    def one(x, y):
        if x is None or y is None:
            return None
        if x == y:
            return 100.0
        s, t = (x, y) if len(x) <= len(y) else (y, x)
        hit = best_window(s, t, 1.0)
        other = best_window(t, s, 1.0) if len(s) == len(t) else None
        return max((h[0] for h in (hit, other) if h), default=0.0)

    return pd.Series([one(x, y) for x, y in zip(a, b)], index=a.index, dtype="object").astype("float64")


def token_set_parts(a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    """(shared text, shared + only-a text, shared + only-b text, subset flag) of two token sets."""
    ta = F.array_distinct(F.filter(F.split(a, " +"), lambda t: t != ""))
    tb = F.array_distinct(F.filter(F.split(b, " +"), lambda t: t != ""))
    shared = F.array_sort(F.array_intersect(ta, tb))
    only_a, only_b = F.array_sort(F.array_except(ta, tb)), F.array_sort(F.array_except(tb, ta))
    subset = (F.size(shared) > 0) & ((F.size(only_a) == 0) | (F.size(only_b) == 0))
    join = lambda *parts: F.array_join(F.concat(*parts), " ")
    return join(shared), join(shared, only_a), join(shared, only_b), subset


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best ratio among the shared tokens and the two full sorted token lists; 100 when one holds the other."""
    shared, full_a, full_b, subset = token_set_parts(a, b)
    full = indel_ratio(F.when(~subset, full_a), F.when(~subset, full_b))
    n0 = F.length(shared).cast("double")
    # a shared prefix is a whole subsequence of the longer text, so its ratio needs no scoring
    prefix = lambda t: F.when(n0 > 0, 200.0 * n0 / (n0 + F.length(t))).otherwise(0.0)
    empty = (F.length(F.trim(a)) == 0) | (F.length(F.trim(b)) == 0)
    return F.when(empty, 0.0).when(subset, 100.0).otherwise(F.greatest(full, prefix(full_a), prefix(full_b)))


def token_set_may_reach(a: Column, b: Column, cutoff: float) -> Column:
    """False only where `token_set_ratio` is under the cutoff: a bound from lengths and Levenshtein distance, in the JVM."""
    shared, full_a, full_b, subset = token_set_parts(a, b)
    n0 = F.length(shared)
    share = 1 - cutoff / 100
    rest = lambda t: F.substr(t, n0 + F.lit(1))
    full = F.levenshtein(rest(full_a), rest(full_b)) <= share * (F.length(full_a) + F.length(full_b)) + 1e-9
    prefix = lambda t: (n0 > 0) & (200.0 * n0 / (n0 + F.length(t)) >= cutoff - 1e-9)
    return subset | prefix(full_a) | prefix(full_b) | full


def cer(pred: Column, truth: Column) -> Column:
    return F.levenshtein(pred, truth) / F.greatest(F.lit(1), F.length(truth))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def _nearest_entries(texts: list[str], entries: list[str], cutoff: float) -> list[tuple[str, float] | None]:
    distinct = list(dict.fromkeys(texts))
    best: dict[str, tuple[str, float]] = {}
    ti, ei, sc = pairs_over(distinct, entries, cutoff)
    for i, e, s in zip(ti.tolist(), ei.tolist(), sc.tolist()):
        if distinct[i] not in best or s > best[distinct[i]][1]:
            best[distinct[i]] = (entries[e], s)
    return [best.get(t) for t in texts]


def best_entry(entries: list[str], cutoff: float) -> Callable[[Column], Column]:
    """The entry of a short fixed list nearest to a text (first wins a tie), over the cutoff: struct(value, score)."""
    known = list(entries)

    @F.pandas_udf("value string, score double")
    def match(texts: pd.Series) -> pd.DataFrame:
        found = _nearest_entries([t or "" for t in texts], known, cutoff)
        return pd.DataFrame(
            {"value": [f[0] if f else None for f in found], "score": pd.Series([f[1] if f else None for f in found], dtype="float64")}
        )

    return match


def best_entry_per_word(entries: list[str], cutoff: float, min_len: int = 3) -> Callable[[Column], Column]:
    """For each word of at least min_len letters the nearest entry over the cutoff, or NULL; order kept."""
    known = list(entries)

    @F.pandas_udf("array<string>")
    def match(texts: pd.Series) -> pd.Series:
        words = [[w for w in (t or "").split(" ") if len(w) >= min_len] for t in texts]
        flat = iter(_nearest_entries([w for ws in words for w in ws], known, cutoff))
        return pd.Series([[f[0] if f else None for f in (next(flat) for _ in ws)] for ws in words])

    return match


def phrase_windows(phrases: list[str], cutoff: float) -> Callable[[Column], Column]:
    """Fixed phrases found in a text: array of (phrase_id, score). Texts under half a phrase's length are skipped."""
    known, grams = list(phrases), _Grams(phrases, cutoff)

    def find(texts: pd.Series) -> pd.Series:
        lines = [t or "" for t in texts]
        distinct = list(dict.fromkeys(lines))
        tries = [(i, k) for i, line in enumerate(distinct) for k in grams.near(line) if len(line) >= len(known[k]) * 0.5]
        found: dict[str, list] = {}
        for (i, k), hit in zip(tries, best_windows([(known[k], distinct[i]) for i, k in tries], cutoff)):
            if hit:
                found.setdefault(distinct[i], []).append({"phrase_id": k, "score": hit[0]})
        return pd.Series([found.get(line, []) for line in lines])

    return _once(find, "array<struct<phrase_id:int,score:double>>")


def phrase_prefilter(phrases: list[str], cutoff: float) -> str:
    """A pattern every text near one of the phrases must match; runs inside the JVM before any scoring.

    Pieces share their beginnings in it, for the alternatives of a pattern are tried one by one at every letter.
    """
    import re

    pieces = {p for ph in phrases for _, p in _pieces(ph, cutoff)}
    pieces = sorted(p for p in pieces if not any(o != p and o in p for o in pieces))

    def shared(rest: list[str]) -> str:
        if len(rest) == 1:
            return re.escape(rest[0])
        heads: dict[str, list[str]] = {}
        for r in rest:
            heads.setdefault(r[:1], []).append(r[1:])
        ways = [re.escape(h) + shared(t) for h, t in heads.items()]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return shared(pieces)


def phrase_spans(phrases: list[str], cutoffs: list[float]) -> Callable[[Column], Column]:
    """Where each fixed phrase sits best in a text: array, phrase by phrase, of struct(score, start, stop) or NULL."""
    jobs = []
    for p, c in zip(phrases, cutoffs):
        grams = _Grams([p], c)
        jobs.append((p, c, [(g, n) for g, ((_, n),) in grams.index.items()], grams.need[0][1]))

    def locate(texts: pd.Series) -> pd.Series:
        lines = [t or "" for t in texts]
        out: list[list] = [[None] * len(jobs) for _ in lines]
        for j, (p, c, grams, need) in enumerate(jobs):
            # a text is long and a phrase short: the phrase's grams are looked for, not the text's
            near = [i for i, line in enumerate(lines) if p in line or sum(n for g, n in grams if g in line) >= need]
            for i, hit in zip(near, best_windows([(p, lines[i]) for i in near], c)):
                if hit:
                    out[i][j] = {"score": hit[0], "start": hit[1], "stop": hit[2]}
        return pd.Series(out)

    return _once(locate, "array<struct<score:double,start:int,stop:int>>")


def span_matches(targets: list[str], cutoffs: list[float], max_words: list[int]) -> Callable[[Column], Column]:
    """Spans starting at one word that match a fixed target.

    Input is the array of match keys of the words from this one onwards. Output is an array of
    (target_id, n_words, score). A span is dropped once it is longer than 1.6 x target + 4. A single
    word that begins with (almost) the whole target and runs on scores 90.
    """
    known, cuts, limits = list(targets), list(cutoffs), list(max_words)
    lens = np.array([len(t) for t in known], dtype=np.float64)
    cut_v, lim_v = np.array(cuts, dtype=np.float64), np.array(limits)
    floor = float(min(cuts))
    heads: dict[str, list[tuple[int, str]]] = {}  # by their first letters, so a word is held against few of them
    for k, t in enumerate(known):
        heads.setdefault(t[:3], []).append((k, t[: max(3, len(t) - 1)]))
    starts = sorted({len(h) for h in heads})

    def find(rows: pd.Series) -> pd.Series:
        out: list[list] = [[] for _ in rows]
        texts: dict[str, int] = {}
        uses: list[tuple[int, int, int]] = []
        for i, words in enumerate(rows):
            if words is None or len(words) == 0:
                continue
            acc = ""
            for n, w in enumerate(words, start=1):
                acc += w
                if len(acc) > lens.max() * 1.6 + 4:
                    break
                uses.append((i, n, texts.setdefault(acc, len(texts))))
            first = words[0]
            for k, head in sorted(x for n in starts for x in heads.get(first[:n], ())):
                if len(first) > len(known[k]) and first.startswith(head):
                    out[i].append({"target_id": k, "n_words": 1, "score": 90.0})
        if texts:
            keys = list(texts)
            ti, ei, sc = pairs_over(keys, known, floor)
            by_text: dict[int, list[tuple[int, float]]] = {}
            for t, e, s in zip(ti.tolist(), ei.tolist(), sc.tolist()):
                if s >= cut_v[e] and len(keys[t]) <= lens[e] * 1.6 + 4:
                    by_text.setdefault(t, []).append((e, s))
            for i, n, t in uses:
                for e, s in by_text.get(t, ()):
                    if n <= lim_v[e]:
                        out[i].append({"target_id": e, "n_words": n, "score": s})
        return pd.Series(out)

    return _once(find, "array<struct<target_id:int,n_words:int,score:double>>")

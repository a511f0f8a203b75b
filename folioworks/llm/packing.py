"""Packing documents into sequences: first-fit decreasing over a tournament tree, in randomised groups.

A document's ids are cut every `length`; full pieces are sequences of their own, and the rest is packed. Documents are dealt
at random into groups of about GROUP documents. Each group packs by itself: its pieces go, longest first, to the first
sequence with room. The sequences' room is kept in a tournament tree whose inner nodes hold the most room below them, so
the first fit is found by one walk from the root. No group's size depends on the data, and only piece lengths are shuffled.

A null text is empty; an empty document still has the closing id. A null doc_id is a value like any other, and repeated rows
are documents of their own. Extra columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common
from folioworks.shipping import ship_by_value

LENGTH = 4096
#: Documents that are packed together, on average.
GROUP = 4096
CLOSING_ID = 2
#: Distinct runs and words a worker remembers; the memory is emptied when it is full.
REMEMBERED = 1_000_000
WORDS_AT_ONCE = 500

PIECES = (
    "pieces", "array<struct<start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint,ids:binary>>",
)
PLAN = "row long, start long, sequence_id long, offset long"


class WordEncoder:
    """Ids of whole texts by a `tokenizers` file, one word of the normalised text at a time.

    The file's own normaliser and cut are applied to runs without spaces, each only once; no word reaches over a space.
    """

    def __init__(self, spec: str):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        read = json.loads(spec)
        self.whole = Tokenizer.from_str(spec)
        self.words = Tokenizer.from_str(spec)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        cut = read["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")
        self.cut = regex.compile(cut + r"|\n").findall
        self.special = tuple(t["content"] for t in read["added_tokens"])
        end = read["model"]["end_of_word_suffix"]
        self.ends = np.zeros(len(read["model"]["vocab"]), dtype=bool)
        self.ends[[i for piece, i in read["model"]["vocab"].items() if piece.endswith(end)]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, words: list[str]) -> None:
        """Ids of words that the cut leaves whole."""
        for k in range(0, len(words), WORDS_AT_ONCE):
            some = words[k : k + WORDS_AT_ONCE]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("a word does not end where its last piece ends")
            raw, last = ids.tobytes(), 0
            for w, stop in zip(some, (4 * stops).tolist()):
                self.known[w] = raw[last:stop]
                last = stop

    def _learn(self, runs: list[str]) -> None:
        """Ids of runs without spaces or line ends."""
        known = self.known
        if any(s in x for x in (" ".join(runs),) for s in self.special):
            for run in [r for r in runs if any(s in r for s in self.special)]:
                known[run] = np.array(self.whole.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()
            runs = [r for r in runs if r not in known]
        words = [r for r in runs if r.isascii() and r.isalpha() and r.islower()]  # already what the normaliser and the cut make of them
        self._encode(words)
        runs = [r for r in runs if r not in known]
        plain = [r for r in runs if r.isascii()]
        other = [r for r in runs if not r.isascii()]
        normal = "\n".join(plain).lower().split("\n") if plain else []
        spelt = self.whole.normalizer.normalize_str(" ".join(other)).split(" ") if other else []
        if len(spelt) != len(other):  # a run held white space other than blanks
            spelt = [self.whole.normalizer.normalize_str(r) for r in other]
        runs = plain + other
        parts = self.cut("\n".join(normal + spelt) + "\n") if runs else []
        self._encode([w for w in set(parts) if w not in known and w != "\n"])
        at, first = 0, 0
        for i, w in enumerate(parts):
            if w == "\n":
                known[runs[at]] = known[parts[first]] if i == first + 1 else b"".join(map(known.__getitem__, parts[first:i]))
                at, first = at + 1, i + 1

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        get = self.known.get
        runs = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        got = [list(map(get, rs)) for rs in runs]
        short = [i for i, g in enumerate(got) if None in g]
        new = {r for i in short for r, g in zip(runs[i], got[i]) if g is None}
        if new:
            self._learn(list(new))
            for i in short:
                got[i] = map(get, runs[i])
        return [b"".join(g) for g in got]


def cut_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, closing: int = CLOSING_ID, with_ids: bool = True) -> DataFrame:
    """One row per document and piece: row, doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids.

    `row` tells repeated documents apart. The table is written, so `row` and the random group stay what they are.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    spec, key = docs.sparkSession.sparkContext.broadcast(content), ("words", hashlib.sha256(content.encode()).hexdigest())
    mark = np.array([closing], dtype="<u4").tobytes()

    def run(texts):
        state = common.worker_state()
        if key not in state:
            state[key] = WordEncoder(spec.value)
        out = []
        for raw in state[key].ids(texts):
            raw += mark
            n = len(raw) // 4
            parts = []
            for start in range(0, n, length):
                part = raw[4 * start : 4 * (start + length)]
                parts.append((start, len(part) // 4, zlib.crc32(part), n, part if with_ids else None))
            out.append(parts)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]))
        names = ("start", "length", "ids_crc32", "doc_tokens", "ids")
        return [pa.array([[dict(zip(names, p)) for p in parts] for parts in out], kind)]

    made = common.map_texts(docs, run, [PIECES], ["doc_id"])
    rows = made.withColumn("row", F.monotonically_increasing_id())
    flat = rows.select("row", "doc_id", F.explode("pieces").alias("p")).select("row", "doc_id", "p.*")
    return common.written(flat if with_ids else flat.drop("ids"), "pieces")


class FirstFit:
    """Room of a growing row of sequences, the leftmost with enough room found in one walk down the tournament tree."""

    def __init__(self, most: int, room: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.best = [room] * (2 * self.leaves)
        self.room = room

    def put(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of this size."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        offset = self.room - best[at]
        best[at] -= size
        leaf = at - self.leaves
        at //= 2
        while at:
            best[at] = max(best[2 * at], best[2 * at + 1])
            at //= 2
        return leaf, offset


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Every piece with sequence_id and offset. Needs row, start and length, at most `length`, and a written table."""
    groups = max(1, -(-pieces.where("start = 0").count() // group))

    def packed(key, table):
        rows, starts, sizes = (table.column(c).to_numpy() for c in ("row", "start", "length"))
        order = np.lexsort((starts, rows, -sizes))
        tree = FirstFit(len(sizes), length)
        got = np.empty((len(sizes), 2), dtype=np.int64)
        for i in order.tolist():
            got[i] = tree.put(int(sizes[i]))
        first = int(key[0].as_py()) << 32
        return pa.table({"row": table.column("row"), "start": table.column("start"), "sequence_id": pa.array(first + got[:, 0]), "offset": pa.array(got[:, 1])})

    slim = pieces.select("row", "start", "length", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("_group"))
    placed = slim.groupBy("_group").applyInArrow(packed, PLAN)
    return pieces.join(placed, ["row", "start"])


def sequences(placed: DataFrame, length: int = LENGTH, padding: int = 0) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, padded to the full length. A sequence is never more than `length` ids."""

    def build(key, table):
        out = np.full(length, padding, dtype="<u4")
        for at, raw in zip(table.column("offset").to_pylist(), table.column("ids").to_pylist()):
            part = np.frombuffer(raw, dtype="<u4")
            out[at : at + len(part)] = part
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([out.astype(np.int64).tolist()], pa.list_(pa.int64()))})

    return placed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(build, "sequence_id long, ids array<bigint>")


ship_by_value(__name__)

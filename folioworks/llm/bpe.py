"""Byte-level BPE through a sentencepiece model that is written directly from a rank vocabulary.

Every byte stands for one printable character, a piece is the string of its bytes' characters, and its score is minus its
rank, so the best-scored merge is the one of lowest rank. Normalisation is the identity. Texts are cut by the tokenizer's
pattern, each piece of text is encoded by itself, and ids are turned back into bytes by the inverse mapping.

Null texts count as empty: no ids, no bytes. Empty tables give empty results. Only the columns named in `keep` are carried.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common
from folioworks.shipping import ship_by_value

#: Distinct pieces of text a worker remembers; the memory is emptied when it is full.
REMEMBERED = 600_000
#: Pieces of text that the model is given in one call, each encoded by itself.
PARTS_AT_ONCE = 200


def byte_characters() -> str:
    """256 characters, one per byte: printable Latin-1 stands for itself, other bytes for characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """Pieces in the order of their ranks, of a file with `base64 rank` lines."""
    ranked = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                piece, rank = line.split()
                ranked[int(rank)] = base64.b64decode(piece)
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranked[i] for i in range(len(ranked))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _whole(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_bytes(pieces: list[bytes]) -> bytes:
    """A serialised sentencepiece model with these pieces at their ranks and the unknown piece behind them."""
    chars = byte_characters()
    out = []
    for rank, piece in enumerate(pieces):
        name = "".join(chars[b] for b in piece).encode()
        out.append(_block(1, _block(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))))
    out.append(_block(1, _block(1, "⁇".encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _whole(3, 2)))
    trainer = _whole(3, 2) + _whole(4, len(pieces) + 1) + _whole(40, len(pieces)) + _whole(41, -1) + _whole(42, -1) + _whole(43, -1)
    normalizer = _block(1, b"identity") + _whole(3, 0) + _whole(4, 0) + _whole(5, 0)
    return b"".join(out) + _block(2, trainer) + _block(3, normalizer)


class Encoder:
    """Encodes whole texts; what it knows of a piece of text it keeps until REMEMBERED is reached."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        # the engines differ in what \s means for the separators U+001C to U+001F: say it by the property
        pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.cut = regex.compile(pattern).findall
        self.unknown = self.model.unk_id()
        self.chars = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        for k in range(0, len(parts), PARTS_AT_ONCE):
            some = parts[k : k + PARTS_AT_ONCE]
            # a line end is no byte's character, so no merge reaches over it: it comes out as the unknown id between two parts
            spelt = [p.encode().decode("latin-1").translate(self.chars) for p in some]
            ids = np.array(self.model.encode("\n".join(spelt), num_threads=1), dtype="<i4")
            raw, last = ids.tobytes(), 0
            stops = [*np.flatnonzero(ids == self.unknown).tolist(), len(ids)]
            if len(stops) != len(some):
                raise ValueError("a part was not encoded by itself")
            for p, stop in zip(some, stops):
                self.known[p] = raw[4 * last : 4 * stop]
                last = stop + 1

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        get, out = self.known.get, []
        for text in texts:
            parts = self.cut(text) if text else []
            got = list(map(get, parts))
            if None in got:
                self._learn(list({p for p, g in zip(parts, got) if g is None}))
                got = map(get, parts)
            out.append(b"".join(got))
        return out


def encode(df: DataFrame, ranks_path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and `ids` array<int> of every whole text. The ranks are read once on the driver (about a megabyte) and sent along."""
    content = model_bytes(read_ranks(ranks_path))
    model, key = df.sparkSession.sparkContext.broadcast(content), ("bpe", hashlib.sha256(content).hexdigest(), pattern)

    def run(texts):
        state = common.worker_state()
        if key not in state:
            state[key] = Encoder(model.value, pattern)
        ids = state[key].ids(texts)
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
        flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]

    return common.map_texts(df, run, [("ids", "array<int>")], keep, text)


def decode(df: DataFrame, ranks_path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """`keep` and `bytes` binary: the bytes that each row's ids stand for; an id outside the vocabulary fails."""
    table = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(lists):
        pieces = table.value
        return [pa.array([b"".join(map(pieces.__getitem__, x or ())) for x in lists], pa.binary())]

    return common.map_texts(df, run, [("bytes", "binary")], keep, ids)


def digest_columns() -> list:
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
    ]


ship_by_value(__name__)

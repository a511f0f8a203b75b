"""Hostile inputs: texts without blanks, containers that nest or lie."""

import random
import struct
import time

import pytest

from folioworks.llm import media, pii


def plain_contexts(text, start, end):
    """The patterns by looking at everything that stands before."""
    before = text[:start]
    left = [w.lower()[-60:] for w in before.split()[-2:]]
    line = before.rsplit("\n", 1)[-1].split()
    glued = "" if not before or before[-1].isspace() else "<"
    after = text[end : end + 60].split()
    right = after[0].lower().strip(".,;:!?") if after and text[end].isspace() else ""
    out = [f"L {left[0]} {left[1]}{glued}"] if len(left) > 1 else []
    out += [f"W {left[-1]}{glued}"] if left else []
    out += [f"B {left[-1]}{glued} _ {right}"] if left and right else []
    out += [f"R {right}"] if right else []
    out += [f"S {line[0].lower()[-60:] if line else ''}{glued}"] if len(line) < 2 else []
    return ["".join("0" if "0" <= c <= "9" else c for c in p) for p in out]


def test_contexts_equal_those_of_the_whole_text_before():
    rng = random.Random(4)
    forms = pii.Forms()
    parts = ["Word ", "x" * 400, "y" * 2000 + " ", "\n", "\n\n", " " * 1500, "\t", "Tel: ", "123456", "998877 ", "a@b.cc", ",", "é" * 70]
    seen = 0
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        words = pii.Before(text)
        got = forms.spans(text)
        for s, e in [(s, e) for _, s, e in got] + forms.candidates(text, got):
            assert pii.contexts(text, s, e, words) == plain_contexts(text, s, e)
            seen += words.starts is not None
    assert seen > 50


def test_a_long_line_without_blanks_takes_linear_time():
    text = ",".join(str(100_000 + i) for i in range(720_000))
    forms, words = pii.Forms(), pii.Before(text)
    t0 = time.process_time()
    found = forms.candidates(text, forms.spans(text))
    assert len(text) > 5_000_000 and len(found) == 720_000
    for s, e in found:
        pii.contexts(text, s, e, words)
    assert time.process_time() - t0 < 60


def box(kind, body=b""):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_broken_containers_say_why(spark):
    good = media.container(b"a" * 576)
    deep = b""
    for _ in range(1500):
        deep = box(b"moov", deep)
    at = good.index(b"stsz") + 8
    lying = good[:at] + struct.pack(">II", 576, 0xFFFFFFF0) + good[at + 8 :]
    # one size for all samples that the file cannot hold; a table longer than its box; a chunk far outside
    table = good[:at] + struct.pack(">II", 0, 0xFFFFFFF0) + good[at + 8 :]
    far = good.index(b"stco") + 12
    outside = good[:far] + struct.pack(">I", 0xFFFFFFFF) + good[far + 4 :]
    with pytest.raises(ValueError, match="nested"):
        list(media.walk(deep))
    rows = [(i, d) for i, d in enumerate([good, deep, lying, table, outside, box(b"moov", b"\x00\x00\x00\x01trak")])]
    got = {r.doc_id: r for r in media.read_frames(spark.createDataFrame(rows, "doc_id long, media binary"), ["doc_id"]).collect()}
    assert got[0].error is None and got[0].n_samples == 1
    assert all(got[i].error and got[i].n_samples is None for i in range(1, 6)), got


def test_boxes_come_in_file_order():
    data = box(b"ftyp") + box(b"moov", box(b"trak", box(b"tkhd")) + box(b"udta")) + box(b"free")
    assert [p for p, _, _ in media.walk(data)] == [(b"ftyp",), (b"moov",), (b"moov", b"trak"), (b"moov", b"trak", b"tkhd"), (b"moov", b"udta"), (b"free",)]

"""The training-data operators on small tables, against brute force, exact round trips and planted cases."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

public_tokenizers = pytest.importorskip("public_tokenizers")

from folioworks.llm import boilerplate, bpe, common, media, neardup, packing, pii, quality, shards, toxicity, warc  # noqa: E402

ROOT = "/root/testdata/sf0.001"
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("row", T.StringType()),
])
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


def documents(spark, texts, ids=None, source="s"):
    """Documents with two extra columns whose names clash with those the operators make."""
    ids = list(range(1, len(texts) + 1)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), 0.5, "mine") for i, t in zip(ids, texts)], DOCS)


def odd(spark):
    """Nulls, an empty text, blanks only, a very long text, repeated rows, a null id, and words of many scripts."""
    texts = [None, "", " \n\t ", LONG, "same text of five words here", "same text of five words here", "repeated row it is", "repeated row it is", "no id but words", "Ünïcode ½ 字漢 👩‍👩‍👧 ΑΣ. \x1c x\u0085y"]
    return documents(spark, texts, [1, 2, 3, 4, 5, 6, 7, 7, None, 10])


def empty(spark):
    return spark.createDataFrame([], DOCS)


# Byte-level BPE and packing.


def test_byte_bpe_equals_the_rank_library_and_decodes(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd(spark).unionByName(spark.read.parquet(f"{ROOT}/documents.parquet").limit(60), allowMissingColumns=True)
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN, ["doc_id", "text"])
    rows = bpe.decode(ids, path, ["doc_id", "text", "ids"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert list(r.ids) == other.encode_ordinary(r.text or "")
        assert bytes(r.bytes) == (r.text or "").encode()
    assert bpe.encode(empty(spark), path, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = odd(spark).unionByName(spark.read.parquet(f"{ROOT}/documents.parquet"), allowMissingColumns=True)
    pieces = packing.cut_pieces(docs, path)
    rows = packing.pack(pieces, group=50).collect()
    tok = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id, zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), len(ids)] += 1
    whole, places = defaultdict(dict), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.length <= packing.LENGTH
        whole[r.row, r.doc_id, r.doc_tokens][r.start] = bytes(r.ids)
        places[r.sequence_id].append((r.offset, r.length))
    got = Counter((d, zlib.crc32(raw := b"".join(p[k] for k in sorted(p))), len(raw) // 4) for (_, d, n), p in whole.items())
    assert got == want and all(len(b"".join(p.values())) == 4 * n for (_, _, n), p in whole.items())
    for at in places.values():
        at.sort()
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and sum(at[-1]) <= packing.LENGTH
    used = sum(n for at in places.values() for _, n in at)
    assert used / (packing.LENGTH * len(places)) > 0.9
    built = packing.sequences(packing.pack(pieces, group=50)).collect()
    assert len(built) == len(places) and all(len(r.ids) == packing.LENGTH for r in built)
    assert packing.pack(packing.cut_pieces(empty(spark), path)).count() == 0


def test_first_fit_is_the_leftmost_fit():
    rng = np.random.default_rng(5)
    sizes = sorted(rng.integers(1, 100, 300).tolist(), reverse=True)
    tree, room = packing.FirstFit(len(sizes), 100), []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), len(room))
        if at == len(room):
            room.append(100)
        assert tree.put(s) == (at, 100 - room[at])
        room[at] -= s


# Shards, boilerplate, archive, media.


def test_shards_are_even_and_gapless(spark):
    docs = odd(spark).unionByName(spark.read.parquet(f"{ROOT}/documents.parquet"), allowMissingColumns=True)
    rows = shards.shard(docs, 6).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) == set(range(6))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    sizes = [sum(r["size"] for r in part) for part in by.values()]
    assert max(sizes) - min(sizes) < max(r["size"] for r in rows)
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect()}
    assert shards.shard(empty(spark), 6).count() == 0


def test_rebalancing_edits_the_map():
    loads = {s: 1 + (s * s) % 97 for s in range(400)}
    start = shards.first_map(7, 400)
    new = shards.rebalance(start, loads, 7)
    total = Counter()
    for s, n in loads.items():
        total[new.shard_of[s]] += n
    assert new.version == 1 and max(total.values()) - min(total.values()) <= 2
    assert sum(a != b for a, b in zip(start.shard_of, new.shard_of)) < 200
    assert shards.rebalance(new, loads, 7).shard_of == new.shard_of


def test_boilerplate_goes_and_odd_rows_stay(spark):
    texts = [f"page {i} text\nShared  line \nmore {i}" for i in range(20)] + ["page 3 text\nonly one"] * 30
    docs = documents(spark, texts, source="h").unionByName(odd(spark)).unionByName(documents(spark, ["Shared  line\nalone"], [99], "other"))
    rows = boilerplate.drop_boilerplate(docs, max_ratio=0.3, min_pages=3).collect()
    assert len(rows) == docs.count()
    assert [r.text for r in rows if r.doc_id == 5 and r.source == "h"] == ["page 4 text\nmore 4"]
    assert all(r.text == "page 3 text\nonly one" for r in rows if r.source == "h" and r.doc_id > 20)  # copies are one page
    assert next(r for r in rows if r.doc_id == 99).text == "Shared  line\nalone"
    nulls = [r for r in rows if r.text is None]
    assert len(nulls) == 1 and (nulls[0].n_lines, nulls[0].n_dropped) == (0, 0)
    assert all(r.row == "mine" for r in rows)
    assert boilerplate.drop_boilerplate(empty(spark)).count() == 0


def test_archive_gives_back_every_page(spark):
    big = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 90 + "</p>"
    pages = [(i, f"https://h/{i}", big) for i in range(1, 40)] + [(100 + i, None, "small") for i in range(30)] + [(200, "u\r\nX: y", None), (201, "u", ""), (None, "u", big), (202, "u", LONG), (202, "u", LONG)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = warc.archive(df)
    rows = warc.read_files(spark, path).collect()
    key = lambda i, h: (-1 if i is None else i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest())
    assert sorted(key(i, h) for i, _, h in pages) == sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest) for r in rows)
    of = defaultdict(list)
    for r in rows:
        of[r.payload_digest].append(r)
    copies = of[hashlib.sha1(big.encode()).hexdigest()]
    assert [r.page_id for r in copies if r.record_type == "response"] == [39]
    assert all(r.refers_to == 39 for r in copies if r.record_type == "revisit") and len(copies) == 40
    twice = of[hashlib.sha1(LONG.encode()).hexdigest()]
    assert sorted(r.record_type for r in twice) == ["response", "revisit"]
    assert all(r.record_type == "response" and r.refers_to is None for r in rows if r.payload_bytes < 1000)
    assert all(bytes(r.payload) == next((h or "").encode() for i, _, h in pages if i == r.page_id and len(h or "") == len(r.payload)) for r in rows if r.record_type == "response" and r.page_id in (39, 200, 202))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_files(spark, warc.archive(none)).count() == 0


def test_a_changed_archive_is_noticed():
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1:0>\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:{}\r\nWARC-Payload-SHA256: {}\r\nContent-Length: {}\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n"
    good = head.format(hashlib.sha1(b"abc").hexdigest(), hashlib.sha256(b"abc").hexdigest(), len(http) + 3).encode() + http
    assert list(warc.parse(good + b"abc\r\n\r\n"))[0][-1] == b"abc"
    with pytest.raises(ValueError):
        list(warc.parse(good + b"abd\r\n\r\n"))


def test_media_round_trip(spark):
    docs = odd(spark)
    rows = media.read_frames(media.write_frames(docs, ["doc_id", "text", "row"]), ["doc_id", "text", "row", "n_bytes"], payload=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        raw = (r.text or "").encode()
        assert bytes(r.payload) == raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576)) and r.n_bytes == len(raw)
        assert (r.codec, r.width, r.height, r.timescale, r.error) == ("raw ", 24, 24, 25, None) and r.duration == r.n_samples == len(r.payload) // 576
        assert [k.sample for k in r.keyframes] == list(range(1, r.n_samples + 1, 12))
    broken = spark.createDataFrame([(1, None), (2, b""), (3, b"abc"), (4, media.container(b"a" * 576)[:-40])], "doc_id long, media binary")
    assert all(r.error and r.codec is None for r in media.read_frames(broken, ["doc_id"]).collect())


def test_sample_tables_of_other_shapes():
    data = bytes(range(200)) * 5

    def box(kind, body):
        return struct.pack(">I4s", 8 + len(body), kind) + body

    sizes, offsets = [7, 5, 9, 4], [300, 20]  # three samples in the first chunk, one in the second
    tables = {
        b"stsz": struct.pack(">III4I", 0, 0, 4, *sizes), b"co64": struct.pack(">II2Q", 0, 2, *offsets), b"stsc": struct.pack(">II6I", 0, 2, 1, 3, 1, 2, 1, 1),
    }
    at, track, raw = 0, {}, data
    for kind, body in tables.items():
        track[kind] = (len(raw) + 8, len(raw) + 8 + len(body))
        raw += box(kind, body)
    o, s = media.sample_ranges(raw, track)
    assert o.tolist() == [300, 307, 312, 20] and s.tolist() == sizes and at == 0
    assert media.samples(raw, (o, s)) == data[300:321] + data[20:24]
    with pytest.raises(ValueError):
        list(media.walk(struct.pack(">I4s", 99, b"moov")))


# Quality.


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines, seen, again = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(inside)


def test_quality_counts_equal_brute_force(spark):
    docs = odd(spark).unionByName(spark.read.parquet(f"{ROOT}/documents.parquet"), allowMissingColumns=True)
    docs = docs.unionByName(documents(spark, ["a b c d e f g h i " * 5, "x\n\nx\n \n x\nx", "a b\x1cc\u0085d " * 30]))
    for r in quality.counted(docs, ["doc_id", "text"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text)
    assert quality.judge(empty(spark), ["doc_id"]).count() == 0


def test_estimation_finds_the_accuracies():
    rng = np.random.default_rng(3)
    good, right = rng.random(20_000) < 0.7, (0.9, 0.8, 0.7, 0.6, 0.85)
    votes = np.stack([np.where(rng.random(len(good)) < 0.2, 0, np.where(rng.random(len(good)) < p, 1, -1) * np.where(good, 1, -1)) for p in right], 1)
    patterns = Counter(map(tuple, votes.tolist()))
    post, found = quality.estimate(list(patterns.items()))
    assert abs(found["good"] - 0.7) < 0.04
    assert np.abs(np.array(found["right_if_good"]) - right).max() < 0.05 and np.abs(np.array(found["right_if_bad"]) - right).max() < 0.07
    sure = dict(zip(patterns, post))
    assert np.mean([(sure[tuple(v)] >= 0.5) == g for v, g in zip(votes.tolist(), good)]) > 0.9


def test_quality_keeps_what_labels_call_good(spark):
    root = "/root/testdata/sf0.01"
    got = quality.judge(spark.read.parquet(f"{root}/documents.parquet"), ["doc_id"]).where("not base_failed")
    rows = got.join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= 0.15 * n[0, False]


# Toxicity.


def test_lattices_are_read_back():
    texts = ["you idiot and moron", "the stupid clown", "a pathetic loser", "worthless trash and scum", "disgusting words in the text"] * 30
    codes, total = toxicity.letter_codes(), np.zeros(toxicity.ALPHABET**3, dtype=np.int64)
    x = codes[np.frombuffer(" ".join(texts).encode("utf-32-le"), dtype="<u4")]
    np.add.at(total, (x[:-2] * toxicity.ALPHABET + x[1:-1]) * toxicity.ALPHABET + x[2:], 1)
    reader = toxicity.Reader(toxicity.character_model([(i, int(n)) for i, n in enumerate(total) if n]))
    for disguised, meant in [("1d10t", "idiot"), ("$tup1d", "stupid"), ("l0ser!", "loser"), ("s t u p i d", "stupid"), ("s.c.u.m", "scum"), ("looooser", "loser"), ("tr@sh", "trash"), ("m0r0n", "moron"), ("WORTHL3SS", "worthless"), ("stuuuupiiiid", "stupid")]:
        assert meant in reader.read(f"so {disguised} it is")[1].split("\n"), disguised
    assert reader.read("plain words, 12 of them! on day 14")[1] == ""
    assert reader.read(None) == ("", "") and reader.read("a " * 50_000)[1]


def test_disguises_are_read_wherever_they_stand():
    texts = ["you idiot and moron", "the stupid clown", "a pathetic loser", "worthless trash and scum", "disgusting words in the text", "such an ass and a fag"] * 30
    codes, total = toxicity.letter_codes(), np.zeros(toxicity.ALPHABET**3, dtype=np.int64)
    x = codes[np.frombuffer(" ".join(texts).encode("utf-32-le"), dtype="<u4")]
    np.add.at(total, (x[:-2] * toxicity.ALPHABET + x[1:-1]) * toxicity.ALPHABET + x[2:], 1)
    reader = toxicity.Reader(toxicity.character_model([(i, int(n)) for i, n in enumerate(total) if n]))
    cases = [('"id1ot"', "idiot"), ("[id1ot]", "idiot"), ("you,id1ot", "idiot"), ("dumb/id1ot", "idiot"), ("so-called-id1ot", "idiot"), ("worthle$$", "worthless"), ("a$$", "ass"), ("tra$#", "trash"),
             ("tr@$#", "trash"), ("f a g", "fag"), ("s,c,u,m", "scum"), ("id!o+", "idiot"), ("s   c   u   m", "scum"), ("s\nc\nu\nm", "scum")]
    for disguised, meant in cases:
        assert meant in reader.read(f"see {disguised} there")[1].split("\n"), disguised
    finder = toxicity.Finder(["idiot ", "stupid ", "scum "])
    for broken, sign in [("id iot", 0), ("st-up-id", 1), ("sc.um", 2), ("an id\niot", 0)]:
        assert list(finder.find_broken(f"the {broken} there", reader)) == [sign], broken
    assert not finder.find_broken("the idiot, stupid. and scum", reader) and not finder.find_broken("", reader)
    assert not finder.find_broken("a placid iota and sc" + " " * 9 + "um", reader)


def test_viterbi_equals_the_best_of_all_paths():
    rng = np.random.default_rng(2)
    model = np.log(rng.dirichlet(np.ones(toxicity.ALPHABET), (toxicity.ALPHABET, toxicity.ALPHABET))).astype(np.float32)
    index = {c: i + 1 for i, c in enumerate(toxicity.LETTERS)}
    for span in ["1d10t", "a$$1b", "x y z w", "aaab!c"]:
        paths = [("", 0.0)]
        for step in [*toxicity.lattice(span), [(" ", 0.0)]]:
            paths = [(t + s, c + k) for t, c in paths for s, k in step]

        def cost(t, c):
            a = b = 0
            total = -c
            for ch in t:
                z = index.get(ch, toxicity.ALPHABET - 1 if ch.isalpha() else 0)
                total += float(model[a, b, z])
                a, b = b, z
            return total

        assert toxicity.readings(span, model, index)[0] == max(paths, key=lambda p: cost(*p))[0].strip()


def test_frequent_signs_and_signs_at_the_start_are_chosen():
    signs = ["often ", "first ", "once "]
    held = [{0: f"you are {'abcdef'[d % 6]} "} for d in range(60)] + [{1: ""} for _ in range(30)] + [{2: "the same  "} for _ in range(30)] + [{} for _ in range(400)]
    chosen, base = toxicity.choose(signs, held, [True] * 120 + [False] * 400, (1.0, 1.0), 3.0)
    assert set(chosen) == {"often ", "first "} and base < 0.3


def test_every_sign_with_evidence_is_chosen():
    """700 words, ten toxic documents each, and as many of clean ones: none is left out for its place in the order."""
    signs = [f"bad{i:03d} " for i in range(700)] + [f"ok{i:03d} " for i in range(700)]
    held = [{i: f"place {d}"} for i in range(1400) for d in range(10)]
    toxic = [i < 700 for i in range(1400) for _ in range(10)]
    chosen, base = toxicity.choose(signs, held, toxic, (9.0, 1.0), math.log(2 * len(signs)))
    assert set(chosen) == set(signs[:700]) and min(chosen.values()) > 0.9 and base < 0.3


def test_toxicity_on_labelled_and_odd_rows(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (10**9, 1, 1)], labels.schema))
    model = toxicity.learn(docs, more)
    planted = documents(spark, ["You are such a L 0 S E R", "what an 1d10t wrote this", "nothing to see here", "stuuuupid thing"], [-1, -2, -3, -4])
    out = toxicity.score(docs.select("doc_id", "text").unionByName(planted.select("doc_id", "text")).unionByName(odd(spark).select("doc_id", "text")), model, ["doc_id"])
    held = out.where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").select("score", "toxic", "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    hit = lambda k, lang: np.mean([r.score >= 0.3 for r in held if r.toxic == k and r.lang == lang])
    assert hit(1, "en") > 0.85 and hit(0, "en") < 0.02
    for lang in ("de", "fr", "es"):
        assert hit(1, lang) > 0.8 and hit(0, lang) < 0.07, lang
    scores = {r.doc_id: r.score for r in out.where("doc_id < 0").collect()}
    assert scores[-2] > 0.3 and scores[-4] > 0.3 and scores[-3] < 0.3
    assert all(0 <= r.score <= 1 for r in out.collect())
    none = toxicity.learn(docs, labels.where("toxic = 0"))
    assert not none.signs and toxicity.score(empty(spark), none, ["doc_id"]).count() == 0


def test_different_texts_with_a_common_word_stay_in_the_sample(spark):
    rng = np.random.default_rng(12)
    filler = [f"w{i}" for i in range(3000)]
    texts = [" ".join([*rng.choice(filler, 30), "are", *rng.choice(filler, 30)]) for _ in range(60)]
    copies = [f"{texts[0]} end", texts[1], texts[1].upper()]
    docs = documents(spark, texts + copies)
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(1, 61)] + [(61, 1, 1), (62, 1, 0), (63, 1, 1)], "doc_id long, quality int, toxic int")
    free = {r.doc_id for r in labels.where(~toxicity.held_out(F.col("doc_id"))).collect()}
    kept = {r.doc_id for r in toxicity.different(docs, labels).collect()}
    lost = {c for c, first in ((61, 1), (62, 2)) if first in free}  # 63 copies 2 too, but in the other class
    assert kept == free - lost
    assert toxicity.sample(docs, toxicity.different(docs, labels)).count() == len(kept)


# Near duplicates.


def components(texts, words, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [f"w{rng.integers(0, 5000)}" for _ in range(120)]
    shared = [f"p{k}" for k in range(60)]
    texts = {}
    for i in range(1, 91):
        copy = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 5)):
            copy[k] = f"n{rng.integers(0, 10**6)}"
        texts[i] = " ".join(copy)
    for i in range(100, 140):  # one passage in many different texts
        texts[i] = " ".join([*(f"u{rng.integers(0, 10**6)}" for _ in range(50)), *shared, *(f"u{rng.integers(0, 10**6)}" for _ in range(50))])
    texts |= {200: "", 201: None, 202: " \n", 203: "one two", 204: "One  TWO", 205: "one two three", 206: LONG, 207: LONG + " tail", 208: "Ä b c d e", 209: "ä b c d e"}
    docs = documents(spark, list(texts.values()), list(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, neardup.Rule(4, 80)).collect()}
    assert got == components(texts, 4, 80)


def test_remaining_components_of_a_bucket_are_compared(spark):
    """The comparison across components by itself: every similar pair in different components of a bucket, none within."""
    signer, rng = neardup.Signer(), np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    rows, members = [], {}
    for i in range(12):
        found = np.unique(np.concatenate((base[: 400 - 8 * (i % 3)], rng.integers(0, 1 << 62, 8 * (i % 3) + 1, dtype=np.uint64))) if i < 9 else rng.integers(0, 1 << 62, 400, dtype=np.uint64))
        members[i] = set(found.tolist())
        rows.append((i, [int(x) for x in signer.sign(found)[1]]))
    nodes = common.written(spark.createDataFrame(rows, "node long, bits array<bigint>"), "t")
    here = common.written(spark.createDataFrame([(7, i, i // 2, None) for i in range(12)], "band long, node long, component long, j double"), "t")
    whole = spark.createDataFrame([(i, np.array(sorted(m), dtype=np.uint64).tobytes()) for i, m in members.items()], "node long, members binary")

    class Known:
        def of(self, wanted):
            return whole.join(wanted, "node", "left_semi")

    got = {frozenset((r.u // 2, r.v // 2)) for r in neardup._across(here, nodes, Known(), 80).collect()}
    near = {frozenset((i // 2, j // 2)) for i in range(12) for j in range(i) if i // 2 != j // 2 and len(members[i] & members[j]) / len(members[i] | members[j]) >= 0.8}
    assert near and near == got


def test_near_duplicates_of_odd_rows(spark):
    rows = neardup.near_duplicates(odd(spark), neardup.Rule(4, 80)).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert (by[5].component_id, by[6].component_id, by[6].kept) == (5, 5, False)
    assert all(r.kept and r.component_id == 7 for r in rows if r.doc_id == 7) and by[None].kept
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (1, 2, 3))
    left = neardup.drop_near_duplicates(odd(spark), neardup.Rule(4, 80))
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, None, 10])) and left.columns == odd(spark).columns
    assert neardup.near_duplicates(empty(spark)).count() == 0


# Personal data.


def by_form(x):
    forms = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    fits = [
        lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")),
        lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d), lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15,
    ]
    return [(k, m.start(), m.end()) for k in range(4) for m in re.finditer(forms[k], x) if fits[k](m[0])]


def test_forms_equal_the_plain_patterns():
    rng = np.random.default_rng(8)
    forms = pii.Forms()
    cases = ["a@b.c.@d.ef x", "1.2.3.4.5.6.7.8", "1.2.3 4.5.6.7", "999.1.1.1.2.3.4", "+1 (017) 555-7713 rest", "4111 1111-1111 1111", "a@b a@b.c@d.e", "٣.1.1.1", "00000000000000000255.1.1.1", "x" * 20_000 + "@", "9" * 5000]
    cases += ["".join(rng.choice(list("a1.@+-( )_%0é\n4"), 60)) for _ in range(3000)]
    for x in cases:
        assert forms.spans(x) == by_form(x), x


def test_contexts_find_unseen_identifiers(spark):
    rng = np.random.default_rng(9)

    def card():
        d = "".join(map(str, rng.integers(0, 10, 15)))
        return next(d + str(c) for c in range(10) if pii.luhn(d + str(c)))

    texts = [f"noise {i} words my card is {card()} thanks" for i in range(12)] + [f"other {i} text the order was A{1000 + i}77 shipped" for i in range(12)]
    texts += ["and so my card is 123456789 thanks", "again the order was 888777 shipped"]
    rows = {r.doc_id: r for r in pii.find(documents(spark, texts), ["doc_id", "text"]).collect()}
    found = rows[25].spans
    assert [(pii.KINDS[s.kind], rows[25].text[s.start : s.end]) for s in found] == [("card", "123456789")]
    assert not rows[26].spans and all(r.base == r.spans for i, r in rows.items() if i != 25)
    masked = {r.doc_id: r.text for r in pii.redact(documents(spark, texts)).collect()}
    assert masked[25] == "and so my card is [CARD] thanks" and masked[26] == texts[25] and masked[1] == "noise 0 words my card is [CARD] thanks"


def test_one_word_and_line_start_contexts_find_identifiers(spark):
    names = "alice bob carol dave erin frank grace heidi ivan judy".split()
    texts = [f"{n} phone +1 (017) 555-77{10 + i} {n}" for i, n in enumerate(names)] + [f"Mail: {n}@some.org {n}" for n in names]
    texts += ["zoe phone 555-1234567 zoe", "Mail: zoe@localhost zoe", "zoe order 555-1234567 zoe", f"{'x' * 70} phone 777-1234567 zoe"]
    rows = {r.doc_id: r for r in pii.find(documents(spark, texts), ["doc_id", "text"]).collect()}
    spans = {i: [(pii.KINDS[s.kind], r.text[s.start : s.end]) for s in r.spans] for i, r in rows.items()}
    assert spans[21] == [("phone", "555-1234567")] and spans[22] == [("email", "zoe@localhost")]
    assert spans[24] == [("phone", "777-1234567")] and all(r.base == r.spans for i, r in rows.items() if i < 21 or i == 23)


def test_personal_data_of_odd_rows(spark):
    more = odd(spark).unionByName(documents(spark, ["mail é x@y.zz and 10.0.0.1, +1 (017) 555-7713"], [50]))
    rows = pii.find(more, ["doc_id", "text"]).collect()
    assert len(rows) == more.count()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.base] == by_form(r.text or "")
    out = pii.redact(more)
    assert out.columns == more.columns and out.count() == more.count()
    assert out.where("doc_id = 50").first().text == "mail é [EMAIL] and [IP], [PHONE]"
    assert pii.redact(empty(spark)).count() == 0


def test_hot_join_equals_a_plain_join(spark):
    left = common.written(spark.range(3000).select(F.when(F.col("id") < 1000, 1).otherwise(F.col("id") % 50).alias("k"), "id"), "t")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most")).where("k <> 7")
    for how in ("inner", "left"):
        a = common.hot_join(left, right, "k", how=how).select("k", "id", "most")
        b = left.join(right, "k", how).select("k", "id", "most")
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_patterns_agree_on_white_space():
    assert regex.findall(r"\p{White_Space}", "\x1c\x1f\x85  ") == ["\x85", " ", " "]

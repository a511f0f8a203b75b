"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import boilerplate, bpe, centroids, licenses, media, neardup, packing, pii, quality, resample, shards, toxicity, warc
from folioworks.llm.registry import query
from folioworks.session import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 24


@query("op1_toxicity")
def toxic_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels that are not held out."""
    docs = table(spark, root, "documents")
    out = toxicity.score(docs, toxicity.learn(docs, table(spark, root, "labels")), ["doc_id"])
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_signs")


@query("op2_quality")
def quality_votes(spark: SparkSession, root: str) -> DataFrame:
    """Every document's counts, the rules' posterior and whether it is kept."""
    out = quality.judge(table(spark, root, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 9).alias("p_good"))


@query("op3_byte_bpe")
def byte_bpe(spark: SparkSession, root: str) -> DataFrame:
    """Ids of every document and the bytes they decode to."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, ["doc_id"]).select("doc_id", "ids", *bpe.digest_columns())
    back = bpe.decode(ids, RANKS, ["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op4_archive")
def web_archive(spark: SparkSession, root: str) -> DataFrame:
    """Every page's record as it is read back from the archive's files."""
    path = warc.archive(table(spark, root, "pages"))
    return warc.read_files(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_personal_data")
def personal_data(spark: SparkSession, root: str) -> DataFrame:
    """Every document's personal data, by form and by learnt context."""
    out = pii.find(table(spark, root, "documents"), ["doc_id"])
    counts = [pii.count_of(k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.spelt("base"), 256).alias("base_sha256"), pii.spelt("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_found"))


@query("op6_near_duplicates")
def near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Every document's component of near duplicates by shingles of four words."""
    return neardup.near_duplicates(table(spark, root, "documents"), neardup.Rule(words=4, percent=80))


@query(
    "op7_line_dedup",
    f"""WITH d AS (SELECT doc_id, source, text, n_chars, lang FROM documents),
    pages AS (SELECT DISTINCT source, text FROM d WHERE text IS NOT NULL),
    totals AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
    ln AS (SELECT DISTINCT source, text, trim(l, ' ' || chr(9) || chr(13)) AS line
           FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS l FROM pages)),
    freq AS (SELECT ln.source, line FROM ln JOIN totals t ON ln.source IS NOT DISTINCT FROM t.source WHERE line <> ''
             GROUP BY ln.source, line, n HAVING count(*) >= {boilerplate.MIN_PAGES} AND count(*) > {boilerplate.MAX_RATIO} * n),
    parts AS (SELECT source, text, p, string_split(text, chr(10))[p] AS l
              FROM (SELECT source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM pages)),
    kept AS (SELECT parts.source, text, count(*) AS n_lines, count(f.line) AS n_dropped,
                    coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (f.line IS NULL), '') AS new_text
             FROM parts LEFT JOIN freq f ON parts.source IS NOT DISTINCT FROM f.source AND trim(l, ' ' || chr(9) || chr(13)) = f.line
             GROUP BY parts.source, text)
    SELECT d.doc_id, d.source, d.lang, d.n_chars, k.new_text AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
    FROM d LEFT JOIN kept k ON d.source IS NOT DISTINCT FROM k.source AND d.text = k.text""",
)
def line_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Every document without the lines that its source repeats."""
    return boilerplate.drop_boilerplate(table(spark, root, "documents"))


@query("op8_media")
def media_columns(spark: SparkSession, root: str) -> DataFrame:
    """Every document stored as frames in a media container, read back, with what its sample tables say."""
    stored = media.write_frames(table(spark, root, "documents"), ["doc_id"]).select("doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    out = media.read_frames(stored, ["doc_id", "n_bytes", "media_bytes", "media_sha256"], payload=True)
    keys = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"], k["length"])), ",")
    feature = F.format_string("codec=%s;size=%dx%d;duration=%d/%d;samples=%d;keyframes=%d;ranges=%s", "codec", "width", "height", "duration", "timescale", "n_samples", F.size("keyframes"), F.sha2(keys, 256))
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )


@query("op9_shards")
def shard_records(spark: SparkSession, root: str) -> DataFrame:
    """Every document's shard of 24 and its place there, by slots whose map was edited until the shards' bytes were near equal."""
    out = shards.shard(table(spark, root, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "version")


@query("op10_packing")
def pack_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    placed = packing.pack(packing.cut_pieces(table(spark, root, "documents"), WORDS, with_ids=False))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query(
    "op11_resample",
    f"""WITH crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) AS v FROM range(256) AS r(i))),
    d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
    b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM benchmark),
    dw AS (SELECT row, unnest(ws) AS w FROM d),
    bw AS (SELECT unnest(ws) AS w FROM b),
    crcs AS (SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda i: ('0x' || hex(encode(w))[2 * i + 1 : 2 * i + 2])::BIGINT),
                                      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {resample.BUCKETS} AS bucket
             FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc_table),
    s AS (SELECT bucket, count(*) AS s FROM dw JOIN crcs USING (w) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM bw JOIN crcs USING (w) GROUP BY bucket),
    g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {resample.BUCKETS})::DOUBLE
                 / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {resample.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
    sums AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS total FROM dw JOIN crcs USING (w) JOIN g USING (bucket) GROUP BY row),
    w AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
                 ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN sums USING (row)),
    scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * able // 100 THEN r END AS rank FROM ranked""",
)
def resample_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every document's weight and score, and the tenth of them drawn towards the benchmark's words."""
    out = resample.resample(table(spark, root, "documents"), table(spark, root, "benchmark"), percent=10, least_words=20, seed=2024, runs=1, buckets=10_000)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _clusters_sql(k: int, rounds: int, seed: int, dims: int) -> str:
    """The rounds unrolled: squared distances by inner products, exact in doubles."""
    parts = [
        f"""v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)) AS x FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), vec_id) - 1 AS cluster, x AS c FROM v QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (SELECT vec_id, row, any_value(x) AS x, min(struct_pack(d := d, cluster := cluster)) AS m
            FROM (SELECT vec_id, row, x, cluster, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM v, c{i}) GROUP BY vec_id, row)""")
        if i < rounds:
            means = ", ".join(f"floor(sum(x[{j}]) / count(*))" for j in range(1, dims + 1))
            parts.append(f"m{i} AS (SELECT m.cluster AS cluster, [{means}] AS c FROM a{i} GROUP BY m.cluster)")
            parts.append(f"c{i + 1} AS (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return f"""WITH {", ".join(parts)},
    o AS (SELECT vec_id, m.cluster AS cluster, m.d::BIGINT AS distance FROM a{rounds})
    SELECT vec_id, o.cluster, distance, sum(distance) OVER (PARTITION BY o.cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
           sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM o JOIN c{rounds} USING (cluster)"""


@query("op12_centroids", _clusters_sql(40, 5, 2, 64))
def centroid_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Every vector's cluster of 40 after five rounds, its distance and the inertia."""
    out = centroids.cluster(table(spark, root, "embeddings"), k=40, rounds=5, seed=2, dims=64)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query("op13_licenses")
def license_labels(spark: SparkSession, root: str) -> DataFrame:
    """Every document's license phrases, and the labels of the templates that its text holds whole."""
    out = licenses.scan(table(spark, root, "documents"), ["doc_id"])
    names = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", *names, "score")

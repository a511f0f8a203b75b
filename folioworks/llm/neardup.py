"""Near duplicates by b-bit MinHash, confirmed on whole sets.

Every text becomes its set of word shingles, as 64-bit hashes. Of HASHES minima per set only the low BITS bits are kept,
packed into longs; their bands of ROWS full minima give candidate buckets. Two packed signatures estimate the similarity by a
count of differing bits, corrected for values that agree by chance, and what may reach the threshold is confirmed on the whole
sets. At a similarity of 0.8 a pair shares no band, or falls under the margin of the estimate, about 3 times in a million.

Equal sets are one node. Buckets never emit all their pairs: first every member is compared with two pivots of its bucket; members
that are then in different components of the same bucket meet in blocks of bounded size, where packed bits and distances to
the pivot rule pairs out and whole sets confirm the others. A link is lost only if its ends are already
in one component.

Texts without words have no shingles and are linked with nothing. A null doc_id sorts behind all others; a component of nulls
only has a null id. Repeated rows are one node and share its component. Extra columns do not matter here. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm import common
from folioworks.operators.graph import connected_components
from folioworks.shipping import ship_by_value

BANDS, ROWS, BITS = 32, 5, 4
HASHES = BANDS * ROWS
LONGS = HASHES * BITS // 64
#: Pairs with a pivot are measured from this estimate on, for their distances rule other pairs out.
FAR = 0.45
#: Deviations of the estimate that a pair may lie under the threshold and still be confirmed.
MARGIN = 4.5
#: Members of a bucket on each side of a block, about.
SIDE = 512
#: Pairs that share one copy of a pivot's set.
SHARED = 256


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words, in lower case of A-Z, are linked from `percent` of intersection over union."""

    words: int = 5
    percent: int = 80


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than a shingle has are one shingle."""
    import xxhash

    parts = text.encode().lower().split() if text else []  # bytes: only A-Z change, only U+0009-U+000D and U+0020 split
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
    width = min(words, len(h))
    by = _constants(words, 11)
    total = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total += h[k : k + len(total)] * by[k]
    return np.unique(_mix(total))


class Signer:
    def __init__(self):
        self.times, self.plus = _constants(HASHES, 12), _constants(HASHES, 13)
        self.band = _constants(ROWS, 14)
        self.number = _constants(BANDS, 15)

    def minima(self, found: np.ndarray) -> np.ndarray:
        best = None
        for k in range(0, len(found), 2048):
            part = ((found[k : k + 2048, None] * self.times + self.plus) >> np.uint64(32)).min(0)
            best = part if best is None else np.minimum(best, part)
        return best

    def sign(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys, and the low bits of all minima packed into longs."""
        m = self.minima(found)
        keys = _mix((m.reshape(BANDS, ROWS) * self.band).sum(1, dtype=np.uint64) + self.number)
        low = (m & np.uint64((1 << BITS) - 1)).reshape(LONGS, 64 // BITS)
        packed = (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64)
        return keys.view(np.int64), packed.view(np.int64)


def signed(docs: DataFrame, rule: Rule, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep`, n_shingles, set_key (digest of the set), bands and bits (both null without shingles) of every row, written."""

    def run(texts):
        import xxhash

        signer, keys, sizes, bands, bits = Signer(), [], [], [], []
        for t in texts:
            found = shingles(t, rule.words)
            sizes.append(len(found))
            a, b = signer.sign(found) if len(found) else (None, None)
            keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            bands.append(a)
            bits.append(b)
        many = pa.list_(pa.int64())
        return [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, many), pa.array(bits, many)]

    fields = [("n_shingles", "bigint"), ("set_key", "binary"), ("bands", "array<bigint>"), ("bits", "array<bigint>")]
    return common.written(common.map_texts(docs, run, fields, ["doc_id", *keep], text), "signed")


def estimate(a: str = "bits", b: str = "other") -> Column:
    """Similarity from two packed signatures: the share of equal values, less what chance alone makes equal."""
    low = F.lit(int(("0" * (BITS - 1) + "1") * (64 // BITS), 2))

    def differing(x: Column) -> Column:
        step = 1
        while step < BITS:  # any differing bit of a value ends up in its lowest
            x, step = x.bitwiseOR(F.shiftrightunsigned(x, step)), 2 * step
        return F.bit_count(x.bitwiseAND(low))

    differ = sum((differing(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(LONGS)), F.lit(0))
    chance = 1 / (1 << BITS)
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """The estimate under which a pair of this similarity falls with a probability of a few in a million."""
    chance, j = 1 / (1 << BITS), percent / 100
    agree = chance + (1 - chance) * j
    return j - MARGIN * math.sqrt(agree * (1 - agree) / HASHES) / (1 - chance)


def _with_bits(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) whose estimate is `least` or more, with it. v may be in any number of pairs."""
    bits = nodes.select("node", "bits")
    counts = pairs.groupBy("v").agg(F.count("*").alias("n"))
    right = bits.withColumnRenamed("node", "v").withColumnRenamed("bits", "other").join(counts, "v")
    both = common.hot_join(pairs, right, "v").join(bits.withColumnRenamed("node", "u"), "u")
    return both.withColumn("estimate", estimate()).where(F.col("estimate") >= least).drop("bits", "other")


class Sets:
    """Whole sets of the nodes that pairs name, made from the texts when they are first asked for, and kept in the shared folder."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, rule: Rule, text: str):
        self.docs, self.nodes, self.rule, self.text = docs, nodes, rule, text

    def of(self, wanted: DataFrame) -> DataFrame:
        """(node, members) of a table of nodes."""
        words = self.rule.words
        no_id = F.coalesce("doc_id", F.lit(-(1 << 63)))
        asked = self.nodes.join(wanted, "node", "left_semi").select("node", "set_key", no_id.alias("_id"))
        texts = self.docs.select(no_id.alias("_id"), F.col(self.text).alias("text")).join(asked.select("_id").distinct(), "_id", "left_semi")

        def run(texts):
            import xxhash

            raw = [shingles(t, words).tobytes() for t in texts]
            return [pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())]

        made = common.map_texts(texts, run, [("set_key", "binary"), ("members", "binary")], ["_id"])
        return common.written(made.join(asked, ["_id", "set_key"]).dropDuplicates(["node"]).select("node", "members"), "sets")

    def measure(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) with their similarity j, and whether that links them. A set that many pairs share is copied for every SHARED of them."""
        pairs = common.written(pairs.select("u", "v"), "pairs")
        sets = self.of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
        counts = pairs.groupBy("v").agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / SHARED).cast("int"))
        dealt = common.hot_join(pairs, counts, "v").withColumn("copy", F.pmod(F.xxhash64("u"), F.col("copies")).cast("int")).drop("copies")
        copied = sets.join(counts, sets["node"] == counts["v"]).select("v", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("members").alias("b"))
        both = dealt.join(sets.select(F.col("node").alias("u"), F.col("members").alias("a")), "u").join(copied, ["v", "copy"]).select("u", "v", "a", "b")
        percent = self.rule.percent

        def run(batches):
            for t in batches:
                j, linked = [], []
                for x, y in zip(t.column(2), t.column(3)):
                    a, b = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                    both = np.sort(np.concatenate((a, b)), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    union = len(a) + len(b) - shared
                    j.append(shared / union)
                    linked.append(100 * shared >= percent * union)
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(j, pa.float64()), pa.array(linked, pa.bool_())], names=["u", "v", "j", "linked"])

        return common.written(both.mapInArrow(run, "u long, v long, j double, linked boolean"), "links")


def _labels(links: DataFrame) -> DataFrame:
    return common.written(connected_components(links, "u", "v"), "labels")


def link(docs: DataFrame, nodes: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """(node, component) of all linked nodes. `nodes` has node, doc_id, set_key, bands and bits and is written."""
    sets = Sets(docs, nodes, rule, text)
    rows = nodes.select("node", F.explode("bands").alias("band"))
    turn = F.struct(F.xxhash64("node").alias("h"), "node")
    counts = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.min(turn).alias("t")).where("n > 1")
    counts = common.written(counts.select("band", "n", F.array("first", "t.node").alias("pivots")), "buckets")
    crowded = common.written(common.hot_join(rows, counts, "band"), "crowded")
    pairs = common.written(crowded.select(F.col("node").alias("u"), F.explode("pivots").alias("v")).where("u <> v").distinct(), "pairs")
    measured = sets.measure(_with_bits(pairs, nodes, FAR))
    links = measured.where("linked").select("u", "v")
    labels = _labels(links)
    at = crowded.select("band", F.col("node").alias("u"), F.col("pivots")[0].alias("v")).join(measured.select("u", "v", "j"), ["u", "v"], "left")
    at = at.select("band", F.col("u").alias("node"), F.when(F.col("u") == F.col("v"), 1.0).otherwise(F.col("j")).alias("j"))
    here = common.written(at.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    more = _across(here, nodes, sets, rule.percent)
    return labels if more.isEmpty() else _labels(links.unionByName(more))


def _across(here: DataFrame, nodes: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Links (u, v) between members of one bucket that are in different components; one for each two components and block.

    One side are the members outside the bucket's first component, the other all members. Both are cut into blocks of about
    SIDE, and every two blocks meet in one task with their packed bits and whole sets. Distances to the bucket's pivot, where
    they were measured, rule out pairs: Jaccard distance is a metric, so two sets differ at least as much as their distances
    to a third. What the estimate leaves is counted on the whole sets, all pairs of two blocks in one product of matrices.
    """
    parts = here.groupBy("band", "component").agg(F.count("*").alias("k"))
    split = parts.groupBy("band").agg(F.sum("k").alias("n"), F.min(F.struct("component", "k")).alias("f"), F.count("*").alias("parts")).where("parts > 1")
    over = lambda c: F.ceil(c / SIDE).cast("int")
    split = common.written(split.select("band", "n", F.col("f.component").alias("lo"), over(F.col("n") - F.col("f.k")).alias("rows"), over(F.col("n")).alias("columns")), "split")
    dealt = common.written(common.hot_join(here, split, "band"), "dealt")
    whole = sets.of(dealt.select("node").distinct())
    data = nodes.select("node", "bits").join(whole, "node")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = ["band", "node", "component", "lo", "j"]
    a = dealt.where("component <> lo").withColumn("row", block("rows")).select(*one, "row", every("columns").alias("column"), F.lit(True).alias("stray"))
    b = dealt.withColumn("column", block("columns")).select(*one, "column", every("rows").alias("row"), F.lit(False).alias("stray"))
    both = a.unionByName(b).join(data, "node")
    least = least_estimate(percent)

    def compare(table):
        import pyarrow.compute as pc

        def side(stray):
            t = table.filter(pc.equal(table.column("stray"), stray))
            bits = np.array(t.column("bits").to_pylist(), dtype=np.int64).reshape(-1, LONGS).view(np.uint64)
            members = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("members")]
            j = np.array([np.nan if x is None else x for x in t.column("j").to_pylist()], dtype=float)
            return t.column("node").to_numpy(), t.column("component").to_numpy(), j, bits, members

        none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        (u, cu, ju, bu, su), (v, cv, jv, bv, sv) = side(True), side(False)
        if not len(u) or not len(v):
            return none
        lo = table.column("lo")[0].as_py()
        open_ = (cu[:, None] != cv[None, :]) & ((cv[None, :] == lo) | (cu[:, None] < cv[None, :]))
        open_ &= ~(np.abs(ju[:, None] - jv[None, :]) > 1 - percent / 100 + 1e-9)
        differ = np.zeros(open_.shape, dtype=np.int64)
        low = np.uint64(int(("0" * (BITS - 1) + "1") * (64 // BITS), 2))
        for k in range(LONGS):
            x, step = bu[:, None, k] ^ bv[None, :, k], 1
            while step < BITS:
                x, step = x | (x >> np.uint64(step)), 2 * step
            differ += np.bitwise_count(x & low)
        chance = 1 / (1 << BITS)
        open_ &= ((1 - differ / HASHES) - chance) / (1 - chance) >= least
        if not open_.any():
            return none
        held = np.intersect1d(np.unique(np.concatenate(su)), np.unique(np.concatenate(sv)), assume_unique=True)
        shared = np.zeros(open_.shape)
        for k in range(0, len(held), 4096):  # as many shingles at a time as keep the matrices small
            some = held[k : k + 4096]
            left, right = (np.array([np.isin(some, m, assume_unique=True) for m in x], dtype=np.float32) for x in (su, sv))
            shared += left @ right.T
        sizes = np.array([len(m) for m in su])[:, None] + np.array([len(m) for m in sv])[None, :]
        x, y = np.nonzero(open_ & (100 * shared >= percent * (sizes - shared)))
        _, first = np.unique(np.stack((cu[x], cv[y])), axis=1, return_index=True)
        return pa.table({"u": pa.array(u[x[first]], pa.int64()), "v": pa.array(v[y[first]], pa.int64())})

    return common.written(both.groupBy("band", "row", "column").applyInArrow(compare, "u long, v long").distinct(), "across")


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep`, n_shingles, component_id (smallest doc_id that links reach) and kept (it is the document's own) of every row."""
    rows = signed(docs, rule, text, keep)
    some = rows.where("n_shingles > 0")
    sets = some.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    nodes = common.written(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = link(docs, nodes, rule, text)
    ends = common.written(labels.join(nodes.select("node", "doc_id"), "node"), "ends")
    least = common.written(ends.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "components")
    linked = common.hot_join(ends.select("node", "component"), least, "component").select("node", "component_id", F.lit(True).alias("_linked"))
    named = nodes.join(linked, "node", "left").select("set_key", "n", F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    given = ["doc_id", *keep, "n_shingles"]
    out = common.hot_join(some.select(*given, "set_key"), common.written(named, "named"), "set_key").select(*given, "component_id")
    alone = rows.where("n_shingles = 0").select(*given, F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """All columns of one document of each component, that of the smallest doc_id; of rows that repeat a document wholly, one."""
    k1, k2 = common.text_key(F.col("doc_id"), F.col(text))
    keyed = docs.withColumns({"_k1": k1, "_k2": k2})
    kept = near_duplicates(keyed, rule, text, ("_k1", "_k2")).where("kept").select("_k1", "_k2")
    return keyed.join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2")


ship_by_value(__name__)

"""SimHash near-duplicate components by the generalised pigeonhole principle.

Fingerprint: ASCII-lower-cased words, 4-word shingles with repeats (fewer words: the whole sequence; no word:
fingerprint 0), XXH64 with seed 42 per shingle, a bit is 1 if set in over half of the hashes.

Linking: all pairs of fingerprints within `max_distance` differing bits, without comparing all pairs. The 64 bits are
grouped into partitions so that correlated bits share one; partition i gets a threshold t_i >= -1 with
sum(t_i + 1) = max_distance + 1. Were every partition of a pair to differ in more than t_i bits, the pair would differ
in at least sum(t_i + 1) > max_distance bits, so each true pair meets in a partition within its threshold. The
thresholds come from a dynamic programme over candidate counts estimated on a bounded sample; they change the work,
never the result. Each fingerprint is filed under its own value in every used partition and probes the values within
t_i bits; those that meet are verified on all 64 bits.

Defined cases: null text = empty text; equal documents share a fingerprint, so they are always linked; repeated rows
each give a row; a null doc_id takes part in linking and is ignored by `component_id` unless its whole component is
null; other columns of the input are ignored by `components` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlake.llm.common import bounded_sample, materialise, utf8

BITS = 64


def shingle_hashes(text: bytes, width: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of an UTF-8 text, A-Z lowered."""
    words = text.lower().split()  # bytes: lowers A-Z only, splits on \x20\x09-\x0D only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the 64-bit fingerprint as a signed long."""

    @F.arrow_udf("bigint")
    def fingerprint(column: pa.Array) -> pa.Array:
        data, offsets = utf8(column)
        raw = data.tobytes()
        found = [simhash(shingle_hashes(raw[a:b], width, seed)) for a, b in zip(offsets[:-1], offsets[1:])]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint(F.col("text").cast("string")).alias("fp"))


# ---------------------------------------------------------------- partitions and thresholds


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bit positions into equal groups; each takes, one by one, the bit most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    centred = bits - bits.mean(axis=0)
    scale = np.sqrt((centred**2).mean(axis=0))
    scale[scale == 0] = 1.0
    strength = np.abs((centred / scale).T @ (centred / scale)) / max(1, len(bits))
    free, groups = list(range(BITS)), []
    for i in range(parts):
        size = len(free) // (parts - i)
        group = [min(free, key=lambda b: (abs(bits[:, b].mean() - 0.5), b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def extract(values: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group, packed into the low bits."""
    out = np.zeros(len(values), np.uint64)
    for i, bit in enumerate(group):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(i)
    return out


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of `width` bits with at most `radius` set; none for a negative radius."""
    if radius < 0:
        return np.zeros(0, np.uint64)
    masks = level = {0}
    for _ in range(radius):
        level = {m | (1 << b) for m in level for b in range(width)} - masks
        masks = masks | level
    return np.array(sorted(masks), np.uint64)


def plan_partitions(sample: np.ndarray, total: int, max_distance: int, most_parts: int = 6) -> list[tuple[list[int], int]]:
    """Bit groups with their thresholds: the cheapest allocation over 2 to `most_parts` partitions.

    Cost of threshold t on a partition: rows filed and probed plus pairs expected to meet there, the sample's meeting
    rate scaled to `total` fingerprints. Allocation by dynamic programming over partitions and the sum of (t_i + 1).
    """
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, most_parts + 1):
        groups = group_bits(sample, parts)
        cost = np.full((parts, max_distance + 2), np.inf)
        for i, group in enumerate(groups):
            cost[i, 0] = 0.0
            values = extract(sample, group)
            counts = pd.Series(values).value_counts()
            keys = counts.index.to_numpy(np.uint64)
            for t in range(min(max_distance, 2) + 1):
                masks = ball(len(group), t)
                meet = 0.0
                for m in masks:
                    meet += float((counts.reindex(keys ^ m).fillna(0).to_numpy() * counts.to_numpy()).sum())
                chance = max(0.0, meet - len(sample)) / max(1, len(sample)) ** 2 + len(masks) / 2.0 ** len(group) * 0.1
                cost[i, t + 1] = total * 4.0 * (1 + len(masks) * (t > 0)) + chance * total * total / 2
        table, back = np.full((parts + 1, max_distance + 2), np.inf), {}
        table[0, 0] = 0.0
        for i in range(parts):
            for used in range(max_distance + 2):
                for t1 in range(max_distance + 2 - used):
                    if (c := table[i, used] + cost[i, t1]) < table[i + 1, used + t1]:
                        table[i + 1, used + t1], back[i + 1, used + t1] = c, t1
        if best is None or table[parts, max_distance + 1] < best[0]:
            used, chosen = max_distance + 1, []
            for i in range(parts, 0, -1):
                t1 = back[i, used]
                if t1:
                    chosen.append((groups[i - 1], t1 - 1))
                used -= t1
            best = (table[parts, max_distance + 1], chosen[::-1])
    return best[1]


# ---------------------------------------------------------------- probing and verification


def _file_and_probe(plan: list[tuple[list[int], int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for lo in range(0, len(fps), 4096):
                fp = fps[lo : lo + 4096]
                for i, (group, t) in enumerate(plan):
                    own = extract(fp, group)
                    for m in ball(len(group), t):
                        keys = own ^ m
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(fp), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), m == 0))],
                            names=["part", "key", "fp", "own"],
                        )

    return run


def local_forest(filed: np.ndarray, probing: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Verified links between two lists of fingerprints, thinned to a spanning forest: (member, root) pairs."""
    nodes = np.unique(np.concatenate([filed, probing]))
    if len(nodes) < 2:
        return []
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where_filed, where_probing = np.searchsorted(nodes, filed), np.searchsorted(nodes, probing)
    for lo in range(0, len(probing), 512):
        near = np.bitwise_count(probing[lo : lo + 512, None] ^ filed[None, :]) <= max_distance
        rows, cols = np.nonzero(near)
        for a, b in zip(where_probing[lo + rows].tolist(), where_filed[cols].tolist()):
            if a != b:
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(nodes))]
    signed = nodes.view(np.int64).tolist()
    return [(signed[i], signed[r]) for i, r in enumerate(roots) if i != r]


def _verify(max_distance: int):
    """Rows arrive sorted by meeting unit (part, key, filed block, probing block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
                if hi - lo > 1:
                    fp, own = rows[lo:hi, 4].view(np.uint64), rows[lo:hi, 5] != 0
                    out += local_forest(fp[own], fp[~own] if not own.all() else fp[own], max_distance)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["src", "dst"])

        for batch in batches:
            rows = np.stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(6)], axis=1)
            rows = np.ascontiguousarray(np.concatenate([*held, rows]))
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            held = [rows[cut:]]
            if cut:
                yield links(rows[:cut])
        if held and len(held[0]):
            yield links(held[0])

    return run


def link_fingerprints(distinct: DataFrame, max_distance: int = 4, sample_rows: int = 20_000, block: int = 2048) -> DataFrame:
    """Spanning links (src, dst) between distinct fingerprints (column fp) within `max_distance` bits.

    `sample_rows` bounds the sample that the plan is estimated on. A key under which more than `block` fingerprints
    meet is split into blocks that meet pairwise in separate tasks, so no task holds an unbounded group.
    """
    total = distinct.count()
    empty = distinct.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0)
    if total < 2:
        return empty
    sample = bounded_sample(distinct.select("fp"), sample_rows, "fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    plan = plan_partitions(sample, total, max_distance)
    probing = any(t > 0 for _, t in plan)
    rows = distinct.select("fp").mapInArrow(_file_and_probe(plan), "part int, key bigint, fp bigint, own boolean")
    sizes = rows.groupBy("part", "key").agg(F.count(F.when(F.col("own"), 1)).alias("filed"), F.count("*").alias("met"))
    sizes = sizes.where((F.col("filed") >= 1) & (F.col("met") >= 2))
    ceil = lambda n: F.ceil(F.col(n) / block).cast("int")
    sizes = sizes.select("part", "key", ceil("filed").alias("filed_blocks"), ceil("met").alias("met_blocks"))
    mine = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    spread = lambda own, many: F.when(own, F.array(mine(many))).otherwise(F.sequence(F.lit(0), F.col(many) - 1))
    met = rows.join(sizes, ["part", "key"])
    # An own row is filed in its filed block for every probing block, and probes too: it is also a row of its probing block.
    filed = met.where("own").select("part", "key", mine("filed_blocks").alias("a"), F.explode(F.sequence(F.lit(0), F.col("met_blocks") - 1)).alias("b"), "fp", F.lit(1).alias("own"))
    asks = met if probing else met.where(F.col("met_blocks") > 1)
    asks = asks.select("part", "key", F.explode(F.sequence(F.lit(0), F.col("filed_blocks") - 1)).alias("a"), mine("met_blocks").alias("b"), "fp", F.lit(0).alias("own"))
    units = filed.unionByName(asks)
    units = units.repartition("part", "key", "a", "b").sortWithinPartitions("part", "key", "a", "b")
    return units.mapInArrow(_verify(max_distance), "src bigint, dst bigint").distinct()


def connected(nodes: DataFrame, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each, by alternating large-star and small-star steps.

    The links stay a distributed table; each round is one written table, so lost executors cost a re-read only.
    """
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = materialise(links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = digest(edges)
    for _ in range(most_rounds):
        # Large star: every larger neighbour of a node is hung on the smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are hung on the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        after = materialise(small.distinct())
        edges, before, state = after, state, digest(after)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def grouped(docs: DataFrame, max_distance: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id), one row per input row; root names the component, also where ids clash."""
    fps = materialise(fingerprints(docs, width))
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected(distinct.select(F.col("fp").alias("node")), link_fingerprints(distinct, max_distance))
    classes = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "first_id")
    classes = materialise(classes)
    ids = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(ids, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def components(docs: DataFrame, max_distance: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id = smallest reachable doc_id), one row per input row."""
    return grouped(docs, max_distance, width).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, max_distance: int = 4) -> DataFrame:
    """Keep one document of each component, see `keep_first`."""
    return keep_first(docs, grouped(docs, max_distance))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One document of each component of groups (doc_id, text_hash, root, component_id): that with the smallest doc_id.

    Of texts that share this doc_id within a component one stays, and of rows that share doc_id and text one. A document
    without a doc_id stays only if its component has no other.
    """
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.first("component_id").alias("kept_id"), F.min("text_hash").alias("kept_hash"))
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["kept_id"]) & (F.xxhash64(docs["text"]) == first["kept_hash"]), "left_semi")
    columns = docs.columns
    plain = [c for c in columns if c != "doc_id"]
    one = kept.groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.first(F.struct(*[F.col(c) for c in plain])).alias("row"))
    return one.select(*[F.col("doc_id") if c == "doc_id" else F.col("row")[c].alias(c) for c in columns])

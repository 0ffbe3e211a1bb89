"""Near-duplicate removal by shingle similarity: of texts linked by Jaccard similarity >= 0.8 one stays.

A text stands for the set of its 5-word shingles (XXH64 with seed 42 over ASCII-lower-cased words; fewer words: the
whole sequence; no word: the empty set). Texts of one set meet at once. Different sets become candidates in two ways:

* their fingerprints are within 4 bits: operator 10's SimHash (over the set) and its exact search by the generalised
  pigeonhole principle;
* one of their min-hash bands agrees, for similar texts that differ in more bits; with 32 bands of 5 a pair of similarity
  0.8 is missed with probability 3e-6, more similar ones less often.

The candidates' components are then verified: within a component all pairs are compared, block
against block in separate tasks, by exact Jaccard similarity, so only pairs that reach the limit are linked.

Defined cases: those of `simhash.drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlake.llm.common import materialise, utf8
from hitlake.llm.simhash import connected, keep_first, link_fingerprints, shingle_hashes, simhash

BANDS, DEPTH = 32, 5
_RNG = np.random.default_rng(42)
_FACTORS, _SHIFTS = _RNG.integers(0, 1 << 63, (2, BANDS * DEPTH)).astype(np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, width))


def band_keys(hashes: np.ndarray, slab: int = 1 << 12) -> list[int]:
    """One signed 64-bit key a band, from the band's smallest hashes under its permutations."""
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), slab):
        part = hashes[i : i + slab]
        np.minimum(least, (part[None, :] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, DEPTH))]


def set_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, sid, fp, keys): sid is a 64-bit digest of the shingle set, fp its SimHash, keys its bands."""

    @F.arrow_udf("struct<sid: bigint, fp: bigint, keys: array<bigint>>")
    def run(column: pa.Array) -> pa.Array:
        data, offsets = utf8(column)
        raw = data.tobytes()
        sids, fps, keys = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            found = shingle_set(raw[a:b])
            sids.append(xxhash.xxh64_intdigest(found.tobytes(), 7) - (1 << 63))
            fps.append(simhash(found))
            keys.append(band_keys(found))
        return pa.StructArray.from_arrays([pa.array(sids, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["sid", "fp", "keys"])

    return docs.select("doc_id", "text", run(F.col("text").cast("string")).alias("s")).select("doc_id", F.xxhash64("text").alias("text_hash"), "s.*")


def similar(a: np.ndarray, b: np.ndarray, limit: float) -> bool:
    """Whether two ascending sets have a Jaccard similarity of at least `limit`."""
    if min(len(a), len(b)) < limit * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= limit * (len(a) + len(b) - both)


def forest(sids: list[int], sets: list[np.ndarray], left: list[int], right: list[int], limit: float) -> list[tuple[int, int]]:
    """Verified links between two lists of places, thinned to a spanning forest; pairs linked already are not compared."""
    parent = list(range(len(sids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in left:
        for j in right:
            if i != j and (a := find(i)) != (b := find(j)) and similar(sets[i], sets[j], limit):
                parent[max(a, b)] = min(a, b)
                out.append((sids[i], sids[j]))
    return out


def _verify(limit: float):
    """Rows (root, a, b, side, sid, text) arrive sorted by unit (root, a, b); side 0 is block a, 1 is block b."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        sets = [shingle_set((r[5] or "").encode()) for r in rows]
        left = [i for i, r in enumerate(rows) if r[3] == 0]
        right = [i for i, r in enumerate(rows) if r[3] == 1] if rows[0][1] != rows[0][2] else left
        return forest([r[4] for r in rows], sets, left, right, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def done() -> pa.RecordBatch:
            out = links(held)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["src", "dst"])

        for batch in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if row[:3] != unit:
                    if held:
                        yield done()
                    unit, held = row[:3], []
                held.append(row)
        if held:
            yield done()

    return run


def candidate_links(sets: DataFrame) -> DataFrame:
    """(src, dst): every set with the smallest one of each band key that it shares."""
    keys = sets.select("sid", F.explode("keys").alias("key"))
    low = keys.groupBy("key").agg(F.min("sid").alias("dst"), F.max("sid").alias("most")).where("dst <> most").select("key", "dst")
    return keys.join(low, "key").where("sid <> dst").select(F.col("sid").alias("src"), "dst").distinct()


def fingerprint_links(sets: DataFrame, max_distance: int = 4) -> DataFrame:
    """(src, dst) that connect all sets with fingerprints within `max_distance` bits, as `simhash.link_fingerprints` finds them."""
    low = materialise(sets.groupBy("fp").agg(F.min("sid").alias("low")))
    same = sets.join(low, "fp").where("sid <> low").select(F.col("sid").alias("src"), F.col("low").alias("dst"))
    ends = [low.select(F.col("fp").alias(end), F.col("low").alias(f"{end}_sid")) for end in ("src", "dst")]
    near = link_fingerprints(low.select("fp"), max_distance).join(ends[0], "src").join(ends[1], "dst")
    return same.unionByName(near.select(F.col("src_sid").alias("src"), F.col("dst_sid").alias("dst")))


def verified_links(members: DataFrame, limit: float = 0.8, block: int = 256) -> DataFrame:
    """(src, dst) of similarity >= `limit` among members (root, sid, text), all pairs of each root."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "root").withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = placed.withColumn("other", other).select(
        "root", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "sid", "text"
    )
    units = units.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")
    return units.mapInArrow(_verify(limit), "src bigint, dst bigint").distinct()


def grouped(docs: DataFrame, limit: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, root, component_id = smallest doc_id that verified links reach), one row per input row."""
    keyed = materialise(set_keys(docs))
    sets = materialise(keyed.groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("text_hash", "doc_id")).alias("shown"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    nodes = sets.select(F.col("sid").alias("node"))
    met = materialise(fingerprint_links(sets).unionByName(candidate_links(sets)).distinct())
    roots = connected(met.select(F.col("src").alias("node")).union(met.select(F.col("dst").alias("node"))).distinct(), met)
    shown = roots.join(sets, roots["node"] == sets["sid"]).select("root", "sid", F.col("shown.doc_id").alias("shown_id"), F.col("shown.text_hash").alias("shown_hash"))
    # One row stands for a set, whatever the number of its copies.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(shown, F.col("doc_id").eqNullSafe(F.col("shown_id")) & (F.xxhash64("text") == F.col("shown_hash")))
    members = materialise(texts.groupBy("root", "sid").agg(F.first("text").alias("text")))
    final = connected(nodes, verified_links(members, limit))
    classes = materialise(sets.join(final, sets["sid"] == final["node"]).select("sid", "root", "first_id"))
    ids = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return keyed.select("doc_id", "text_hash", "sid").join(classes.join(ids, "root").select("sid", "root", "component_id"), "sid").select("doc_id", "text_hash", "root", "component_id")


def components(docs: DataFrame, limit: float = 0.8) -> DataFrame:
    """(doc_id, component_id), one row per input row."""
    return grouped(docs, limit).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, limit: float = 0.8) -> DataFrame:
    """Keep one document of each component, see `simhash.keep_first`."""
    return keep_first(docs, grouped(docs, limit))

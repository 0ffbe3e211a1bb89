"""Lempel-Ziv phrase fingerprint: likeness of texts as a compressor sees it.

A text's UTF-8 bytes are parsed into dictionary phrases (LZ78: each phrase is the shortest string not parsed before).
Every phrase of the dictionary is hashed, and the `size` smallest hashes are the signature, the fingerprint in hex.
The likeness of two signatures is the share of hashes they have in common among the `size` smallest of both: the
minimum-hash estimate of the Jaccard likeness of the phrase sets, and that likeness itself for small sets.

`compare_with_next` sets each document against the next one (ascending doc_id, null first; ties by text; after the last
the first) and against an edited text whose second half (rounded down) is replaced by the beginning of the next one.
Documents are dealt to key ranges, each with a copy of the first document of the following range, so no single task
sees all and no document is compared without its neighbour.

Defined cases: null text = empty text (empty signature; two empty ones are alike, 1.0; empty and other, 0.0); repeated
rows each give a row and are neighbours of each other; a single document is its own next; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOWEST = -(1 << 63)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Phrases:
    """A dictionary of phrases as a trie: (node, byte) to node, and a hash for each node."""

    __slots__ = ("edges", "hashes", "node")

    def __init__(self, edges: dict[int, int] | None = None, hashes: list[int] | None = None, node: int = 0):
        self.edges, self.hashes, self.node = edges or {}, hashes or [1], node

    def copy(self) -> Phrases:
        return Phrases(self.edges.copy(), self.hashes.copy(), self.node)

    def parse(self, data: bytes) -> Phrases:
        """Go on parsing where the last call stopped."""
        edges, hashes, node = self.edges, self.hashes, self.node
        follow, count = edges.get, len(hashes)
        for byte in data:
            key = node << 8 | byte
            node = follow(key)
            if node is None:
                edges[key] = count
                hashes.append((hashes[key >> 8] * 1_000_003 + byte + 1) & 0x1FFFFFFFFFFFFFFF)
                count += 1
                node = 0
        self.node = node
        return self

    def signature(self, size: int) -> np.ndarray:
        """The smallest distinct hashes, 32 bits each, ascending."""
        h = np.array(self.hashes[1:], np.uint64)
        h = (h ^ (h >> np.uint64(29))) * _MIX
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h = np.unique((h >> np.uint64(32)).astype(np.uint32))
        return h[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    same = both[:-1][both[1:] == both[:-1]]
    joined = np.unique(both)[:size]
    return float(np.count_nonzero(same <= joined[-1]) / len(joined))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _hex(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def _walk(size: int):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def begin(row: dict) -> dict:
        text = row["text"] or ""
        kept = text[: len(text) - len(text) // 2].encode()
        rest = text[len(text) - len(text) // 2 :].encode()
        head = Phrases().parse(kept)
        row |= {"text": text, "head": head, "sign": head.copy().parse(rest).signature(size)}
        return row

    def finish(row: dict, following: dict) -> tuple:
        half = len(row["text"]) // 2
        other = row["head"].parse(following["text"][:half].encode()).signature(size)
        digest = hashlib.sha256(edited(row["text"], following["text"]).encode()).hexdigest()
        return (row["doc_id"], len(row["text"]), digest, _hex(row["sign"]), _hex(other), likeness(row["sign"], other, size), likeness(row["sign"], following["sign"], size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 512):
                for row in batch.slice(lo, 512).to_pylist():
                    if held is not None and held["range"] == row["range"] and not held["extra"]:
                        row = begin(row)
                        out.append(finish(held, row))
                        held = row
                    elif held is None or held["range"] != row["range"]:
                        held = begin(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(7)], names=names)

    return run


def compare_with_next(docs: DataFrame, size: int = 128, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per document."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 8 * parts
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), order.alias("order"))
    steps = keyed.where("doc_id is not null").approxQuantile("order", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    bounds = np.unique(np.array(steps, np.float64)).astype(np.int64)

    @F.arrow_udf("int")
    def range_of(column: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, column.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    # One row per range: its first document is also the last neighbour of the range before it.
    firsts = keyed.select("order").withColumn("range", range_of("order")).groupBy("range").agg(F.min("order").alias("order")).collect()
    firsts = sorted((r["range"], r["order"]) for r in firsts)
    first_of = np.array([o for _, o in firsts], np.int64)
    before = np.array([firsts[i - 1][0] for i in range(len(firsts))], np.int32)

    @F.arrow_udf("array<struct<range: int, extra: int>>")
    def places(column: pa.Array) -> pa.Array:
        values = column.to_numpy(zero_copy_only=False)
        own = np.searchsorted(bounds, values, side="right")
        at = np.searchsorted(first_of, values)
        out = []
        for r, v, i in zip(own.tolist(), values.tolist(), at.tolist()):
            here = [{"range": r, "extra": 0}]
            if i < len(first_of) and first_of[i] == v:
                here.append({"range": int(before[i]), "extra": 1})
            out.append(here)
        return pa.array(out, pa.list_(pa.struct([("range", pa.int32()), ("extra", pa.int32())])))

    dealt = keyed.withColumn("place", F.explode(places("order"))).select("doc_id", "text", "order", "place.range", "place.extra")
    dealt = dealt.repartition(parts, "range").sortWithinPartitions("range", "extra", "order", "text")
    dealt = dealt.select("doc_id", "text", "range", "extra")
    return dealt.mapInArrow(_walk(size), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""Removal of repeated byte strings of `length` bytes or more, found with suffix arrays.

A byte goes if a string of `length` bytes that covers it starts at another place too, in the same document or another.

1. Routing. Every `length`-byte window has an anchor: the `gram`-byte string in it with the smallest hash (leftmost of
   equals). Equal windows have equal anchors, so strings that repeat meet under their anchor; windows in a row that
   share one anchor form an extract. Only the anchor hash, a 128-bit digest and the place of an extract are shuffled.
2. Copies of one extract are added up first; one of them stands for all, and its number of places tells that all of it
   repeats. An anchor with a single extract at a single place has no repeat and drops out.
3. Different extracts under one anchor go to a shard, their bytes joined back from the documents. Each shard builds a
   suffix array over all its extracts by Larsson-Sadakane refinement (ranks by the first symbols, then doubled, only
   unsorted groups sorted again) and Kasai's common prefixes; neighbours that share `length` bytes repeat.
4. An anchor with more than `shard_extracts` extracts is spread over several shards. Each shard then also hands on
   sorted runs of keys, one key for each different window, cut into as many buckets as there are shards; the runs of a
   bucket are merged by binary search. No task holds more than about a shard's share of windows.
5. The repeated stretches are joined back to every place of their extract, united for each document, and cut out.

Every step but the search inside a bounded shard is a Spark shuffle on anchors, digests or documents.

Shorter shared passages (of `report` bytes or more, about 50 words) are not removed but reported: every `report`-byte
window is represented by its `gram`-byte string of smallest hash, and `n_shared` adds up the distances of neighbouring
representatives that stand elsewhere at the same distance too. It is about the number of bytes in shared passages; a
passage shared by two documents has the same representatives in both, save at its edges.

Defined cases: null text = empty text (nothing to remove); repeated rows are places of their own, so a repeated text of
`length` bytes or more goes whole in all of them; texts shorter than `length` stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlake.llm.common import materialise, utf8

_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_MIX = np.uint64(0x9E3779B97F4A7C15)
SEGMENT = 1 << 20  # windows of a long document that are hashed at once


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        factors = np.full(n + 1, base, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors))
    return out[0], out[1]


class Anchors:
    def __init__(self, length: int, gram: int, report: int = 224):
        self.length, self.gram, self.report = length, gram, report
        self.forward, self.back = _powers(1 << 12)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of every gram, by differences of a running polynomial."""
        if len(data) > len(self.forward) - 1:
            self.forward, self.back = _powers(max(len(data), 2 * len(self.forward)))
        running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.forward[: len(data)], out=running[1:])
        n = len(data) - self.gram + 1
        h = (running[self.gram :] - running[:n]) * self.back[:n]
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
        return h

    @staticmethod
    def least(key: np.ndarray, w: int, n: int) -> np.ndarray:
        """The smallest of w keys from each of the first n places on."""
        blocks = -(-len(key) // w)
        grid = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        grid[: len(key)] = key
        grid = grid.reshape(blocks, w)
        from_left = np.minimum.accumulate(grid, axis=1).reshape(-1)
        from_right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        return np.minimum(from_right[:n], from_left[w - 1 : w - 1 + n])

    def scan(self, data: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """For one text: (anchor hash, first window, windows) of each run of windows that shares an anchor, and
        (key, place, distance) of each pair of neighbouring representatives of the `report`-byte windows.
        """
        found: list[tuple[np.ndarray, ...]] = []
        shown: list[tuple[np.ndarray, ...]] = []
        low = np.uint64((1 << 22) - 1)
        for lo in range(0, max(0, len(data) - min(self.length, self.report) + 1), SEGMENT):
            h = self.hashes(data[lo : lo + SEGMENT + max(self.length, self.report) - 1])
            key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the leftmost
            for size, out in ((self.length, found), (self.report, shown)):
                n = min(SEGMENT, len(data) - size + 1 - lo)
                if n > 0:
                    at = (self.least(key, size - self.gram + 1, n) & low).astype(np.int64)
                    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
                    out.append((h[at[first]], first + lo, np.diff(np.concatenate([first, [n]])), at[first] + lo))
        runs, marks = ([np.concatenate([f[i] for f in out]) for i in range(4)] if out else [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3] for out in (found, shown))
        place, where = np.unique(marks[3], return_index=True)
        gap = np.diff(place)
        value = marks[0][where]
        pair = (value[:-1] * _MIX ^ (value[1:] + gap.astype(np.uint64)) * np.uint64(_BASE)) if len(value) else value
        return (runs[0], runs[1], runs[2]), (pair ^ pair >> np.uint64(31), place[:-1], gap)


def _digest(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


PLACES = "kid bigint, th bigint, anchor bigint, d1 bigint, d2 bigint, start bigint, windows int"


def _anchor_rows(length: int, gram: int, report: int):
    """Rows of PLACES: extracts; and, without d1 and d2, pairs of representatives (key, place, distance)."""
    names = ["kid", "th", "anchor", "d1", "d2", "start", "windows"]
    kinds = (*[pa.int64()] * 6, pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram, report)
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            kid, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            columns: list[list] = [[] for _ in names]
            pairs: list[list] = [[] for _ in names]
            held = 0

            def emit() -> Iterator[pa.RecordBatch]:
                for rows in (columns, pairs):
                    if rows[0]:
                        n = sum(map(len, rows[0]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) if c else pa.nulls(n, k) for c, k in zip(rows, kinds)], names=names)
                        for column in rows:
                            column.clear()

            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if hi - lo < min(length, report):
                    continue
                (hashes, first, count), (key, place, gap) = anchors.scan(data[lo:hi])
                if len(first):
                    raw = data[lo:hi].tobytes()
                    d = np.array([_digest(raw[a : a + n + length - 1]) for a, n in zip(first.tolist(), count.tolist())], np.int64)
                    for column, value in zip(columns, (np.full(len(first), kid[i]), np.full(len(first), th[i]), hashes.view(np.int64), d[:, 0], d[:, 1], first, count.astype(np.int32))):
                        column.append(value)
                if len(key):
                    for c, value in zip((0, 1, 2, 5, 6), (np.full(len(key), kid[i]), np.full(len(key), th[i]), key.view(np.int64), place, gap.astype(np.int32))):
                        pairs[c].append(value)
                held += len(first) + len(key)
                if held > 100_000:
                    yield from emit()
                    held = 0
            yield from emit()

    return run


def shared_bytes(pairs: DataFrame) -> DataFrame:
    """(kid, th, n_shared) of the documents with any: distances of pairs (kid, th, anchor, start, windows) with another place."""
    # Written, so that the join has a shuffle on both sides and adaptive execution can split a very common key.
    many = materialise(pairs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    again = pairs.join(many, "anchor").select("kid", "th", "start", "windows").distinct()  # rows of one key are one text
    return again.groupBy("kid", "th").agg(F.sum("windows").alias("n_shared"))


# ---------------------------------------------------------------- suffix arrays


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: sort by a prefix of h symbols, then by the ranks of h and 2h, until all ranks differ.

    Only suffixes whose group still has equals are sorted again.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    used, codes = np.unique(symbols, return_inverse=True)  # as many symbols as fit into the first key
    bits = len(used).bit_length()
    h = 62 // bits
    key = np.zeros(n, np.int64)
    wide = np.concatenate([codes.astype(np.int64) + 1, np.zeros(h, np.int64)])
    for j in range(h):
        key = key << bits | wide[j : j + n]
    order = np.argsort(key)
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1  # the empty suffix
    ordered = key[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tail = np.concatenate([head[1:], [True]])
    open_ = np.flatnonzero(~(head & tail))  # places in `order` whose group is not single
    while len(open_):
        suffixes = order[open_]
        key = rank[suffixes] * (n + 1) + rank[np.minimum(suffixes + h, n)] + 1
        resorted = np.argsort(key)
        suffixes, key = suffixes[resorted], key[resorted]
        order[open_] = suffixes  # groups keep their places, as open_ ascends and groups sort by rank
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffixes] = np.maximum.accumulate(np.where(head, open_, 0))
        tail = np.concatenate([head[1:], [True]])
        open_ = open_[~(head & tail)]
        h *= 2
    return order


def common_prefixes(text: bytes, order: np.ndarray, wanted: np.ndarray | None = None, most: int | None = None) -> np.ndarray:
    """Kasai: lcp[i] of suffixes order[i - 1] and order[i]; each suffix starts from one less than the one before it.

    `wanted` limits the suffixes that are looked at (others get 0), `most` the prefix lengths.
    """
    n = len(text)
    most = n if most is None else most
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    starts = np.arange(n) if wanted is None else np.flatnonzero(wanted)
    found = np.zeros(len(starts), np.int64)
    same, last = 0, -2
    for k, (i, j) in enumerate(zip(starts.tolist(), before[starts].tolist())):
        if j < 0:
            same, last = 0, -2
            continue
        same = same - 1 if same and i == last + 1 else 0
        last = i
        limit = min(most, n - i, n - j)
        if same < limit and text[i + same] == text[j + same]:
            if limit - same <= 512 and text[i + same : i + limit] == text[j + same : j + limit]:
                same = limit
            step = 128
            while step:  # what is still equal in strides, then halves of them
                if same + step <= limit and text[i + same : i + same + step] == text[j + same : j + same + step]:
                    same += step
                else:
                    step >>= 1
        found[k] = same
    lcp = np.zeros(n, np.int64)
    lcp[at[starts]] = found
    return lcp


def repeats_in_shard(extracts: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each extract: which of its windows occurs again in the shard; and the class number of each window."""
    sizes = np.array([len(e) for e in extracts])
    bases = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.full(int((sizes + 1).sum()), 256, np.int64)
    text = b"\x00".join(extracts) + b"\x00"
    inside = np.ones(len(symbols), bool)
    inside[bases + sizes] = False
    raw = np.frombuffer(text, np.uint8)
    symbols[inside] = raw[inside]
    order = suffix_array(symbols)
    left = np.repeat(bases + sizes, sizes + 1) - np.arange(len(symbols))  # bytes up to the end of the own extract
    window = left >= length
    lcp = common_prefixes(text, order, window, length)
    # Equal windows stand side by side, and every suffix between them has the same `length` bytes.
    joint = np.zeros(len(order) + 1, bool)
    joint[1:-1] = (lcp[1:] >= length) & window[order[1:]] & window[order[:-1]]
    again = np.zeros(len(order), bool)
    again[order] = joint[:-1] | joint[1:]
    number = np.zeros(len(order), np.int64)
    number[order] = np.cumsum(~joint[:-1])
    parts = [slice(b, b + s - length + 1) for b, s in zip(bases.tolist(), sizes.tolist())]
    return [again[p] for p in parts], [number[p] for p in parts]


def _stretches(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The bytes covered by flagged windows, as (start, end)."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out: list[tuple[int, int]] = []
    for a, b in zip(begins.tolist(), ends.tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b - 1 + length)
        else:
            out.append((a, b - 1 + length))
    return out


FOUND = "anchor bigint, d1 bigint, d2 bigint, spans array<struct<a: int, b: int>>, bucket int, shard int, keys binary, owners binary"
SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _search(length: int, shard_bytes: int = 1 << 20):
    """Rows (anchor, sub, shards, d1, d2, data) sorted by (anchor, sub): groups are gathered into shards of about shard_bytes.

    Out: the repeated stretches of an extract; and, where an anchor has several shards, runs of sorted window keys with
    their owners (d1, d2, window), one run for each bucket of keys. A class of repeated windows hands on one key.
    """
    kinds = [pa.int64()] * 3 + [SPANS, pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["anchor", "d1", "d2", "spans", "bucket", "shard", "keys", "owners"]

    def runs(anchor: int, sub: int, shards: int, keys: list[int], owners: list[tuple[int, int, int]]) -> Iterator[tuple]:
        key, owner = np.array(keys, np.uint64), np.array(owners, np.int64).reshape(-1, 3)
        bucket = (key % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((key, bucket))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            at = order[lo:hi]
            yield anchor, None, None, None, int(bucket[at[0]]), sub, key[at].tobytes(), owner[at].tobytes()

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        flags, numbers = repeats_in_shard([r[5] for r in rows], length)
        out: list[tuple] = []
        spread: dict[tuple[int, int, int], tuple[list, list, set]] = {}
        for (anchor, sub, shards, d1, d2, data), again, number in zip(rows, flags, numbers):
            if again.any():
                out.append((anchor, d1, d2, [{"a": a, "b": b} for a, b in _stretches(again, length)], None, None, None, None))
            if shards > 1:
                keys, owners, handed = spread.setdefault((anchor, sub, shards), ([], [], set()))
                for i, (c, known) in enumerate(zip(number.tolist(), again.tolist())):
                    if known and c in handed:
                        continue
                    if known:
                        handed.add(c)
                    keys.append(xxhash.xxh3_64_intdigest(data[i : i + length]))
                    owners.append((d1, d2, i))
        for group, (keys, owners, _) in spread.items():
            out += runs(*group, keys, owners)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if rows and row[:2] != rows[-1][:2] and size >= shard_bytes:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield solve(rows)

    return run


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Owners of keys that stand in more than one sorted run: each run is looked up in all by binary search."""
    every = np.sort(np.concatenate([k for k, _ in runs]))
    found = []
    for keys, owners in runs:
        own = np.searchsorted(keys, keys, "right") - np.searchsorted(keys, keys, "left")
        total = np.searchsorted(every, keys, "right") - np.searchsorted(every, keys, "left")
        found.append(owners[total > own])
    return np.concatenate(found)


def _merge(length: int):
    """Rows (anchor, bucket, keys, owners) sorted by (anchor, bucket): the runs of a bucket, one from each shard."""

    def solve(anchor: int, runs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        hits = merge_runs([(np.frombuffer(k, np.uint64), np.frombuffer(o, np.int64).reshape(-1, 3)) for k, o in runs])
        by: dict[tuple[int, int], list[dict]] = {}
        for d1, d2, i in hits.tolist():
            by.setdefault((d1, d2), []).append({"a": i, "b": i + length})
        return pa.RecordBatch.from_arrays([pa.array([anchor] * len(by), pa.int64()), pa.array([d for d, _ in by], pa.int64()), pa.array([d for _, d in by], pa.int64()), pa.array(list(by.values()), SPANS)], names=["anchor", "d1", "d2", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, runs = None, []
        for batch in batches:
            for anchor, bucket, keys, owners in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if group not in (None, (anchor, bucket)):
                    yield solve(group[0], runs)
                    runs = []
                group = (anchor, bucket)
                runs.append((keys, owners))
        if group is not None:
            yield solve(group[0], runs)

    return run


# ---------------------------------------------------------------- the operator


def repeated_stretches(docs: DataFrame, length: int = 400, gram: int = 64, shard_extracts: int = 2048, report: int = 224) -> DataFrame:
    """(kid, th, spans, n_shared): for each document key with any the byte stretches to remove, overlapping ones not yet
    united, and the bytes in shared passages.
    """
    keyed = _keyed(docs)
    rows = materialise(keyed.select("kid", "th", "text").mapInArrow(_anchor_rows(length, gram, report), PLACES))
    shared = shared_bytes(rows.where("d1 is null"))
    places = rows.where("d1 is not null")
    extracts = places.groupBy("anchor", "d1", "d2").agg(F.count("*").alias("copies"), F.min(F.struct("kid", "th", "start", "windows")).alias("at"))
    anchors = extracts.groupBy("anchor").agg(F.count("*").alias("extracts"), F.sum("copies").alias("total")).where("total > 1")
    met = materialise(extracts.join(anchors, "anchor").select("anchor", "d1", "d2", "copies", "extracts", "at.*"))
    whole = met.where("copies > 1").select("anchor", "d1", "d2", F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") + length - 1).alias("b"))).alias("spans"))

    shards = F.ceil(F.col("extracts") / shard_extracts).cast("int")
    searched = met.where("extracts > 1").select("kid", "th", F.struct("anchor", F.pmod("d1", shards).cast("int").alias("sub"), shards.alias("shards"), "d1", "d2", "start", "windows").alias("e"))
    wanted = searched.groupBy("kid", "th").agg(F.collect_list("e").alias("es"))  # bounded by the document's own length
    one = keyed.select("kid", "th", F.encode("text", "UTF-8").alias("raw"))
    cut = lambda e: F.struct(*[e[c].alias(c) for c in ("anchor", "sub", "shards", "d1", "d2")], F.substring(F.col("raw"), (e["start"] + 1).cast("int"), e["windows"] + length - 1).alias("data"))
    bytes_ = one.join(wanted, ["kid", "th"]).select(F.explode(F.transform("es", cut)).alias("e")).select("e.*")
    bytes_ = bytes_.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub").select("anchor", "sub", "shards", "d1", "d2", "data")
    found = materialise(bytes_.mapInArrow(_search(length), FOUND))
    runs = found.where("keys is not null").select("anchor", "bucket", "keys", "owners").repartition("anchor", "bucket").sortWithinPartitions("anchor", "bucket")
    across = runs.mapInArrow(_merge(length), "anchor bigint, d1 bigint, d2 bigint, spans array<struct<a: int, b: int>>")
    again = found.where("keys is null").select("anchor", "d1", "d2", "spans").unionByName(across)
    again = again.groupBy("anchor", "d1", "d2").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # bounded by the extract's length
    marked = whole.unionByName(again.join(whole, ["anchor", "d1", "d2"], "left_anti"))
    spans = places.join(marked, ["anchor", "d1", "d2"]).select("kid", "th", F.explode(F.transform("spans", lambda s: F.struct((F.col("start") + s["a"]).alias("a"), (F.col("start") + s["b"]).alias("b")))).alias("s"))
    found = spans.groupBy("kid", "th").agg(F.collect_set("s").alias("spans"))  # distinct, so bounded by the document's length
    return found.join(shared, ["kid", "th"], "full_outer")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows keyed by (id, hash of the text): rows of one key have one text, and so one result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("kid"), F.xxhash64(text).alias("th"), text.alias("text"))


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 64, shard_extracts: int = 2048, keep_text: bool = False, report: int = 224) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared (and kept, the bytes left, on request)."""
    stretches = repeated_stretches(docs, length, gram, shard_extracts, report)
    joined = _keyed(docs).join(stretches, ["kid", "th"], "left")

    @F.arrow_udf("struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string" + ", kept: binary" * keep_text + ">")
    def cut(column: pa.Array, spans: pa.Array) -> pa.Array:
        data, offsets = utf8(column)
        rows = []
        for lo, hi, found in zip(offsets[:-1].tolist(), offsets[1:].tolist(), spans.to_pylist()):
            raw = data[lo:hi].tobytes()
            kept, at, removed, runs = [], 0, 0, 0
            for a, b in sorted((s["a"], s["b"]) for s in found or []):
                if a > at or not runs:
                    kept.append(raw[at:a])
                    runs += 1
                    removed += b - a
                    at = b
                elif b > at:
                    removed += b - at
                    at = b
            kept.append(raw[at:])
            left = b"".join(kept)
            rows.append((len(raw), removed, runs, hashlib.sha256(left).hexdigest(), left))
        kinds = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())][: 4 + keep_text]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return joined.select("doc_id", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), cut("text", "spans").alias("r")).select("doc_id", "r.*", "n_shared")

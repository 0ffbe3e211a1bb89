"""Cross-entropy difference: how much more likely a document is under a target model than under the background.

Both models are n-gram models of order 4 over one shared vocabulary, the 256 byte values of UTF-8, with the same
smoothing: 4-grams back off to 2-grams and these to single bytes, each with a prior of `prior` pseudo-counts. They are
matched in size: the background's counts, taken over all documents, are scaled to the number of tokens of the target.
A document's score is the mean over its tokens of (target loss - background loss) in nats; lower is nearer the target.
A document is scored without itself: its own counts are taken out of the background, and, if it belongs to the target,
out of the target, so that having been counted does not make it look near.

Counts are exact: a run of four bytes is one 32-bit key, Spark adds the keys up over every token of every document into
a written table, which grows with the corpus, and contexts, pairs and bytes follow from it. The table is cut into
ranges of contexts of at most about `most_sent` keys. Each range is one pass over the texts: it is collected, sent to the
tasks, its losses are written, and it is dropped before the next one is collected. A token's loss needs its own context
only, so the ranges' sums add up to the loss with the whole table. The driver and each task hold one range (36 bytes a
key) and the 65,536 pairs at a time, however many keys there are; the price is one reading of the texts for each range.

Defined cases: null or empty text = no tokens, losses and score 0.0; repeated rows each give a row and count each; no
target document: every target count is 0 and the scores compare a uniform model; other columns are ignored; a null
doc_id never belongs to the target. A text of any length is one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlake.llm.common import materialise, utf8

START = 10  # a line feed stands before each text
MOST_SENT_IDS = 1_000_000  # target ids of 8 bytes that are sent to the tasks; more of them meet the documents in a shuffle
_MIX = np.uint64(0x9E3779B97F4A7C15)


def keys(data: np.ndarray) -> np.ndarray:
    """For each byte of a text the run of four bytes that ends there."""
    wide = np.empty(len(data) + 3, np.uint32)
    wide[:3] = START
    wide[3:] = data
    return wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]


def tallied(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys ascending, how often each)."""
    ordered = np.sort(found)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.concatenate([first, [len(ordered)]]))


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of several tallies."""
    found, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(found, kind="stable")
    found, n = found[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    return found[first], np.add.reduceat(n, first) if len(first) else n


def marked(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, text, is_target). The ids are sent to the tasks if they are few by count; else both sides are shuffled."""
    ids = materialise(target_ids.select(F.col("doc_id").alias("_target_id")).where("_target_id is not null").distinct())
    ids = F.broadcast(ids) if ids.count() <= MOST_SENT_IDS else ids.hint("merge")
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.join(ids, own["doc_id"] == ids["_target_id"], "left").select("doc_id", "text", F.col("_target_id").isNotNull().alias("is_target"))


def count(docs: DataFrame) -> DataFrame:
    """(key, target, background) summed over all tokens of all documents (text, is_target)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            flags = batch.column(1).to_numpy(zero_copy_only=False)
            for target in (0, 1):
                held, size = [], 0
                for i in np.flatnonzero(flags == target).tolist():
                    held.append(keys(data[offsets[i] : offsets[i + 1]]))
                    size += len(held[-1])
                    if size > 1 << 21:
                        sums[target].append(tallied(np.concatenate(held)))
                        held, size = [], 0
                if held:
                    sums[target].append(tallied(np.concatenate(held)))
                if len(sums[target]) > 16:
                    sums[target] = [added(sums[target])]
        for target in (0, 1):
            if sums[target]:
                found, n = added(sums[target])
                for lo in range(0, len(found), 100_000):
                    part = n[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(found[lo : lo + 100_000].astype(np.int64)), pa.array(part * target), pa.array(part)], names=["key", "target", "background"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("is_target").cast("int"), F.lit(0)).alias("is_target"))
    counted = rows.mapInArrow(tally, "key bigint, target bigint, background bigint")
    return counted.groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


@dataclass
class Models:
    """The written counts and their totals."""

    counts: DataFrame  # key, target, background
    pairs: np.ndarray  # (2, 65536): target and background
    cuts: list[int]  # contexts at which a new range begins
    prior: float

    @property
    def totals(self) -> np.ndarray:
        return self.pairs.sum(axis=1)

    def part(self, i: int) -> Part:
        lo, hi = self.cuts[i] << 8, (self.cuts[i + 1] << 8) if i + 1 < len(self.cuts) else 1 << 32
        rows = self.counts.where((F.col("key") >= lo) & (F.col("key") < hi)).toArrow()
        found = rows.column("key").to_numpy().astype(np.uint32)
        order = np.argsort(found)
        both = np.stack([rows.column(c).to_numpy()[order] for c in ("target", "background")])
        return Part(found[order], both, self.pairs, self.prior, lo, hi)


class Part:
    """The counts of a range of contexts, with an exact look-up table (open addressing) of its keys."""

    def __init__(self, found: np.ndarray, both: np.ndarray, pairs: np.ndarray, prior: float, lo: int = 0, hi: int = 1 << 32):
        self.found, self.both, self.pairs, self.prior, self.lo, self.hi = found, both, pairs, prior, lo, hi
        context = found >> np.uint32(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(found) else np.zeros(0, np.int64)
        self.contexts = context[first]
        self.context_sums = np.add.reduceat(both, first, axis=1) if len(first) else np.zeros((2, 0), np.int64)
        bits = max(4, int(2 * len(found)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        waiting, at = np.arange(len(found)), self._slot(found)
        while len(waiting):
            free = self.slots[at] < 0
            self.slots[at[free]] = waiting[free]
            open_ = self.slots[at] != waiting
            waiting, at = waiting[open_], (at[open_] + 1) & self.mask
        self.singles = pairs.reshape(2, 256, 256).sum(axis=1)  # counts of a byte
        self.before = pairs.reshape(2, 256, 256).sum(axis=2)  # counts of a byte that has one after it
        self.total = pairs.sum(axis=1)
        self.scale = np.array([1.0, self.total[0] / self.total[1] if self.total[0] and self.total[1] else 1.0])

    def _slot(self, asked: np.ndarray) -> np.ndarray:
        return ((asked.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        out = np.full(len(asked), -1, np.int64)
        open_, at = np.arange(len(asked)), self._slot(asked)
        while len(open_) and len(self.found):
            got = self.slots[at]
            hit = got >= 0
            same = hit.copy()
            same[hit] = self.found[got[hit]] == asked[open_[hit]]
            out[open_[same]] = got[same]
            go = hit & ~same
            open_, at = open_[go], (at[go] + 1) & self.mask
        return out

    def losses(self, asked: np.ndarray, n: np.ndarray, is_target: bool, counted: bool = True) -> tuple[float, float]:
        """Summed losses of a document's distinct keys (ascending, n of each) under both models, those of this range only.

        `counted`: the document is one of those that were counted, so its own counts are taken out.
        """
        own = np.array([float(counted and is_target), float(counted)])
        pair, inverse = np.unique(asked & np.uint32(0xFFFF), return_inverse=True)
        pair, own_pair = pair.astype(np.int64), np.bincount(inverse, n)
        one, before = pair & 255, pair >> 8
        own_one, own_before = np.bincount(one, own_pair, 256), np.bincount(before, own_pair, 256)
        length = n.sum()
        if self.lo or self.hi < 1 << 32:
            lo, hi = np.searchsorted(asked, np.array([self.lo, self.hi - 1], np.uint64), "left")
            hi += hi < len(asked) and asked[hi] == self.hi - 1
            asked, n, inverse = asked[lo:hi], n[lo:hi], inverse[lo:hi]
        if not len(asked):
            return 0.0, 0.0
        place = self.find(asked)
        context = asked >> np.uint32(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        own_context = np.add.reduceat(n, first)
        if len(self.contexts):
            at = np.minimum(np.searchsorted(self.contexts, context[first]), len(self.contexts) - 1)
            known = self.contexts[at] == context[first]
        else:
            at, known = np.zeros(len(first), np.int64), np.zeros(len(first), bool)
        spread = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(asked)]])))
        out = []
        for m in (0, 1):
            left = lambda value, mine: np.maximum(value - own[m] * mine, 0.0) * self.scale[m]  # noqa: B023, E731
            p = (left(self.singles[m][one], own_one[one]) + 1.0) / (left(self.total[m], length) + 256.0)
            p = (left(self.pairs[m][pair], own_pair) + self.prior * p) / (left(self.before[m][before], own_before[before]) + self.prior)
            four = left(np.where(place >= 0, self.both[m][place], 0) if len(self.found) else np.zeros(len(asked)), n)
            three = left(np.where(known, self.context_sums[m][at], 0) if len(self.contexts) else np.zeros(len(first)), own_context)
            p = (four + self.prior * p[inverse]) / (three[spread] + self.prior)
            out.append(float(-(np.log(p) * n).sum()))
        return out[0], out[1]


def fit(rows: DataFrame, prior: float = 4.0, most_sent: int = 4_000_000) -> Models:
    """Models from all documents, rows of `marked`. What comes to the driver is bounded: pairs, and counts by first byte of a context."""
    counts = materialise(count(rows))
    pair = F.col("key").bitwiseAND(0xFFFF)
    pairs = np.zeros((2, 1 << 16))
    for r in counts.groupBy(pair.alias("pair")).agg(F.sum("target").alias("t"), F.sum("background").alias("b")).collect():
        pairs[:, r["pair"]] = r["t"], r["b"]
    # Contexts by their first two bytes: at most 65,536 sums, and at most 65,536 keys under one of them.
    sizes = counts.groupBy(F.shiftright("key", 16).alias("top")).agg(F.count("*").alias("n")).orderBy("top").collect()
    cuts, held = [0], 0
    for r in sizes:
        if held and held + r["n"] > most_sent:
            cuts.append(r["top"] << 8)
            held = 0
        held += r["n"]
    return Models(counts, pairs, cuts, prior)


def score_documents(rows: DataFrame, models: Models, counted: bool = True) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means per token), score = their difference, for rows of `marked`."""
    context = rows.sparkSession.sparkContext

    def losses(shared):
        @F.arrow_udf("struct<n: bigint, target: double, background: double>")
        def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            part = shared.value
            for column, flags in columns:
                data, offsets = utf8(column)
                flag = flags.to_numpy(zero_copy_only=False)
                n, sums = np.diff(offsets), np.zeros((2, len(offsets) - 1))
                for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    if hi > lo:
                        sums[:, i] = part.losses(*tallied(keys(data[lo:hi])), bool(flag[i]), counted)
                yield pa.StructArray.from_arrays([pa.array(n), pa.array(sums[0]), pa.array(sums[1])], names=["n", "target", "background"])

        return run("text", "is_target")

    own = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce("is_target", F.lit(False)).alias("is_target"))
    if len(models.cuts) == 1:  # one range, one pass: nothing has to be added up
        summed = own.select("doc_id", losses(context.broadcast(models.part(0))).alias("_s")).select("doc_id", "_s.*")
    else:
        own = materialise(own.withColumn("_row", F.monotonically_increasing_id()))  # a row keeps its number in all passes
        parts = None
        for i in range(len(models.cuts)):
            shared = context.broadcast(models.part(i))
            done = materialise(own.select("_row", losses(shared).alias("_s")).select("_row", "_s.*"))
            shared.destroy()
            parts = done if parts is None else parts.unionByName(done)
        summed = parts.groupBy("_row").agg(F.max("n").alias("n"), F.sum("target").alias("target"), F.sum("background").alias("background"))
        summed = own.select("_row", "doc_id").join(summed, "_row")
    per = F.greatest("n", F.lit(1))
    out = summed.select("doc_id", F.col("n").alias("n_tokens"), (F.col("target") / per).alias("target_loss"), (F.col("background") / per).alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))

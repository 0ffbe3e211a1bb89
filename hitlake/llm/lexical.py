"""Ranked lexical search of many queries at once, with common subexpressions evaluated once.

Items share terms. `mine` finds sets of terms that several items share: the pair of nodes that stands in most items
becomes a node of its own, in rounds, until no pair is shared. A node is a term or the sum of two earlier nodes, so the
nodes are a directed graph that queries share. For every document the partial accumulator of each node is computed once,
level by level, and an item's score is the sum of the few nodes that cover its terms.

The documents are read once: a task turns each text into its number of terms and the terms that any item asks for, with
their frequencies, and writes this short form. Document frequencies, N and L come from it by Spark aggregates, and a
second pass over it scores. A task keeps the best `top` documents of an item; Spark takes the best of all tasks. Items
are taken in blocks of at most about `MOST_POSTINGS` (item, term) rows, so what is sent to the tasks stays bounded; the
texts are read once a block.

Weights: with df documents that hold a term of N documents that have any term, w = floor(1000 ln((2N + 2) / (2 df + 1))).
With n terms in the document and L in all, m = 100 - B + ((B n N) div L). The score is the sum of
w ((10^9 tf) div (1000 tf + 8 m)) over the item's distinct terms, in 64-bit integers.

Terms: maximal runs of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased, nothing else is.

Defined cases: null and empty texts have no terms and are never found; an item without terms, or whose terms no document
holds with a positive weight, gives no row. Repeated documents are documents of their own; equal scores go by ascending
doc_id, a null one last. Repeated items are ranked each, with a rank of their own. Other columns are ignored; an empty
table on either side gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitlake.llm.common import materialise, utf8

MOST_POSTINGS = 1_000_000  # (item, term) rows of a block of items, which the driver and each task hold
B = 90
CELLS = 1 << 20  # accumulators (nodes x documents) that a task holds at once
#: Bytes of terms stay, A-Z as lower case; every other ASCII byte becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order, with repeats."""
    return text.translate(FOLD).split()


@dataclass
class Graph:
    """Nodes 0 to n_terms - 1 are terms; node n_terms + i is the sum of the two nodes pairs[i]. An item is a list of nodes."""

    n_terms: int
    pairs: np.ndarray  # (n, 2), children before parents
    items: list[list[int]]

    def levels(self) -> list[np.ndarray]:
        """Composite nodes by height: those of a level depend on lower ones only."""
        height = [0] * (self.n_terms + len(self.pairs))
        for i, (x, y) in enumerate(self.pairs.tolist()):
            height[self.n_terms + i] = 1 + max(height[x], height[y])
        of = np.array(height[self.n_terms :], np.int64)
        return [np.flatnonzero(of == h) for h in range(1, int(of.max(initial=0)) + 1)]


def mine(items: list[list[int]], n_terms: int, reach: int = 64) -> Graph:
    """The graph of shared term sets for items given as distinct terms.

    Nodes of an item stand in the order of how many items have them, and pairs up to `reach` places apart are counted, so
    long items cost no more than their length times `reach`. A round makes nodes of the most shared pairs, each node of
    an item going into one of them; every node made is used by two items or more.
    """
    shared = Counter(t for item in items for t in item)
    held = [sorted(item, key=lambda t: (-shared[t], t)) for item in items]
    pairs: list[tuple[int, int]] = []
    while True:
        where = defaultdict(list)
        for i, nodes in enumerate(held):
            for k, x in enumerate(nodes):
                if shared[x] > 1:
                    for y in nodes[k + 1 : k + 1 + reach]:
                        if shared[y] > 1:
                            where[x, y].append(i)
        made, used = 0, defaultdict(set)
        for (x, y), among in sorted(where.items(), key=lambda w: (-len(w[1]), w[0])):
            if len(among) < 2:
                break
            free = [i for i in among if x not in used[i] and y not in used[i]]
            if len(free) >= 2:
                node = n_terms + len(pairs)
                pairs.append((x, y))
                shared[node] = len(free)
                made += 1
                for i in free:
                    used[i] |= {x, y, node}
                    held[i] = [node if t == x else t for t in held[i] if t != y]
        if not made:
            return Graph(n_terms, np.array(pairs, np.int64).reshape(-1, 2), held)


def reduced(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, found, tf): the number of terms of each document with any, and those of the vocabulary that it holds."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            keep, n, found, tf = [], [], [], []
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                got = terms(data[lo:hi].tobytes())
                if got:
                    counts = Counter(filter(known.__contains__, got))
                    keep.append(i)
                    n.append(len(got))
                    found.append([known[t] for t in counts])
                    tf.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], names=["doc_id", "n", "found", "tf"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(count, "doc_id bigint, n bigint, found array<int>, tf array<int>"))


def weights(short: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """(weight of each term, N, L)."""
    n_docs, total = short.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(n_terms, np.int64)
    for row in short.select(F.explode("found").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # a row per term asked for
        df[row["t"]] = row["df"]
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64), n_docs, total


class Evaluator:
    """Scores of all items of a graph for documents in the short form."""

    def __init__(self, graph: Graph, weight: np.ndarray, n_docs: int, total: int):
        self.graph, self.weight, self.n_docs, self.total = graph, weight, n_docs, total
        self.levels = [(graph.n_terms + at, graph.pairs[at, 0], graph.pairs[at, 1]) for at in graph.levels()]
        self.filled = np.array([i for i, nodes in enumerate(graph.items) if nodes], np.int64)
        self.nodes = np.array([t for nodes in graph.items for t in nodes], np.int64)
        sizes = np.array([len(graph.items[i]) for i in self.filled], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.width = max(1, CELLS // max(1, graph.n_terms + len(graph.pairs) + len(self.nodes)))

    def scores(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """(items with terms x documents); the postings are (place of the document, term, tf)."""
        m = 100 - B + (B * n * self.n_docs) // self.total
        held = np.zeros((self.graph.n_terms + len(self.graph.pairs), len(n)), np.int64)
        held[term, doc] = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        for at, left, right in self.levels:
            held[at] = held[left] + held[right]
        return np.add.reduceat(held[self.nodes], self.starts, axis=0) if len(self.starts) else np.zeros((0, len(n)), np.int64)


def best(item: np.ndarray, score: np.ndarray, doc_id: np.ndarray, unknown: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` rows of each item with the highest scores; equal ones by ascending doc_id, unknown ones last."""
    ranked = np.lexsort((doc_id, unknown, -score, item))
    sorted_item = item[ranked]
    first = np.flatnonzero(np.concatenate([[True], sorted_item[1:] != sorted_item[:-1]])) if len(item) else np.zeros(0, np.int64)
    place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    return ranked[place < top]


def rank_block(short: DataFrame, graph: Graph, top: int, figures: tuple[np.ndarray, int, int]) -> DataFrame:
    """(item, doc_id, score): of each item the `top` best documents of each task."""
    shared = short.sparkSession.sparkContext.broadcast(Evaluator(graph, *figures))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        held = None  # item, score, doc_id and whether it is null, of the best so far
        least = np.ones(len(plan.filled), np.int64)  # a lower score is not among the best any more

        def settled(parts):
            item, score, doc_id, unknown = (np.concatenate(p) for p in zip(*parts))
            keep = best(item, score, doc_id, unknown, top)
            return item[keep], score[keep], doc_id[keep], unknown[keep]

        waiting, size = [], 0
        for batch in batches:
            found, tf = batch.column(2), batch.column(3)
            lengths = np.diff(found.offsets.to_numpy())
            term, often = found.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), lengths)
            through, n = np.cumsum(lengths), batch.column(1).to_numpy()
            ids = np.asarray(batch.column(0).fill_null(0).to_numpy()), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for lo in range(0, batch.num_rows, plan.width):
                hi = min(batch.num_rows, lo + plan.width)
                a, b = int(through[lo] - lengths[lo]), int(through[hi - 1])
                score = plan.scores(n[lo:hi], doc[a:b] - lo, term[a:b], often[a:b])
                item, at = np.nonzero(score >= least[:, None])
                if len(item):
                    waiting.append((item, score[item, at], ids[0][at + lo], ids[1][at + lo]))
                    size += len(item)
                if size > 200_000:
                    held = settled(waiting + ([held] if held else []))
                    waiting, size = [], 0
                    full = np.bincount(held[0], minlength=len(least)) >= top
                    lowest = np.full(len(least), np.iinfo(np.int64).max)
                    np.minimum.at(lowest, held[0], held[1])
                    least[full] = lowest[full]
        parts = waiting + ([held] if held else [])
        if parts:
            item, score, doc_id, unknown = settled(parts)
            yield pa.RecordBatch.from_arrays([pa.array(plan.filled[item]), pa.array(doc_id, pa.int64(), mask=unknown), pa.array(score)], names=["item", "doc_id", "score"])

    return short.mapInArrow(search, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `top` documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            found = [sorted(set(terms(data[lo:hi].tobytes()))) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(split, f"item_id {kind}, terms array<binary>").where("size(terms) > 0")
    asked = materialise(asked.withColumn("row", F.monotonically_increasing_id()))
    postings = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-postings // MOST_POSTINGS))
    out = None
    for block in range(blocks):
        mine_of = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)
        rows = mine_of.select("row", "terms").toArrow().to_pylist()  # about MOST_POSTINGS terms
        vocabulary = sorted({t for r in rows for t in r["terms"]})
        place = {t: i for i, t in enumerate(vocabulary)}
        graph = mine([[place[t] for t in r["terms"]] for r in rows], len(vocabulary))
        short = reduced(docs, vocabulary)
        found = rank_block(short, graph, top, weights(short, len(vocabulary)))
        by_score = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())  # `top` rows of each task
        ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r["row"]) for i, r in enumerate(rows)], "item bigint, row bigint")
        named = ranked.join(F.broadcast(names), "item").join(mine_of.select("row", "item_id"), "row")  # a block's items
        named = named.select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    return out

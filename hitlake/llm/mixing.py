"""Mixing sources to target weights by the cube method of balanced sampling.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words by weight; a target stops at
`most_repeats` times its source's words, and the excess is shared again by weight until none is above. Each document is
then due target / source_size copies: the whole part is taken for certain, the fraction is its inclusion probability.
The flight phase moves these probabilities through the null-space of two constraints, the source's words and its
documents, until no more than two fractions are left. It runs in blocks of bounded size (hash buckets of a source), and
what each block leaves over meets again in new blocks, until one block per source is left; its landing problem, a
dozen documents, takes the outcome nearest to the target, and where a large one leaves it off, some more of its block change
sides: these few do not keep their inclusion probabilities, all the others do. Moves are seeded by the rows, whatever
their order, so reruns agree.

Defined cases: null or empty text = 0 words; null source is a source of its own; a source without words has target 0;
repeated rows are drawn one by one; no words at all: every target 0 and nothing taken; other columns are ignored by
`mix` and kept by `mixed_documents`.
"""

from __future__ import annotations

import random
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitlake.llm.common import WORD, materialise

NEAR = 1e-9
LANDING_DOCS = 12  # all outcomes of the landing are looked at, so this bounds it to 2**14


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most_repeats: float = 3.0) -> DataFrame:
    """(source, source_size, source_docs, target) from (source, size). One small row per source from here on."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    sources = materialise(sources.withColumn("weight", weight))
    most = most_repeats * F.col("source_size")
    total = share * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while total:  # ends: the capped sources only grow in number
        over = F.lit(level) * F.col("weight") > most if level else F.lit(False)
        row = sources.agg(F.count(F.when(over, 1)), F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("weight")))).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], (total - float(row[1] or 0)) / row[2]
    return sources.select("source", "source_size", "source_docs", F.least(F.lit(level) * F.col("weight"), most).alias("target"))


def flight(chance: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Move inclusion probabilities to 0 or 1, keeping their sum and their size-weighted sum; two fractions stay at most."""
    rng = random.Random(seed)
    chance = chance.astype(float).tolist()
    size = size.astype(float).tolist()
    active: list[int] = []
    for k in range(len(chance)):
        if NEAR < chance[k] < 1 - NEAR:
            active.append(k)
        if len(active) < 3:
            continue
        a, b, c = active
        # Null-space of the rows (1, 1, 1) and (size_a, size_b, size_c): their cross product.
        move = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(move):
            move = (1.0, -1.0, 0.0)
        up = min(((1 - chance[i]) / m if m > 0 else chance[i] / -m) for i, m in zip(active, move) if m)
        down = min((chance[i] / m if m > 0 else (1 - chance[i]) / -m) for i, m in zip(active, move) if m)
        step = up if rng.random() * (up + down) < down else -down
        for i, m in zip(active, move):
            chance[i] = min(1.0, max(0.0, chance[i] + step * m))
            if chance[i] < NEAR or chance[i] > 1 - NEAR:
                chance[i] = float(round(chance[i]))
        active = [i for i in active if NEAR < chance[i] < 1 - NEAR]
    return np.array(chance)


def landing(chance: np.ndarray, size: np.ndarray, owed: float) -> np.ndarray:
    """Round the few fractions left so that the words of all are nearest to `owed`, then the number of documents."""
    chance = chance.astype(float).copy()
    open_ = np.flatnonzero((chance > NEAR) & (chance < 1 - NEAR))
    if len(open_):
        settled = float((np.delete(chance, open_) * np.delete(size, open_)).sum())
        outcomes = np.array(list(product((0.0, 1.0), repeat=len(open_))))
        words = np.abs(settled + outcomes @ size[open_] - owed)
        count = np.abs(outcomes.sum(axis=1) - chance[open_].sum())
        chance[open_] = outcomes[np.lexsort((count, words))[0]]
    return chance.round()


def settle(taken: np.ndarray, size: np.ndarray, free: np.ndarray, owed: float) -> np.ndarray:
    """Where a large document left the total off: documents of `free` change sides, each time the one whose size is nearest
    to what is missing or too much, as long as that brings the total nearer.
    """
    taken = taken.copy()
    for _ in range(len(free)):
        missing = owed - float(taken @ size)
        able = free[taken[free] == (missing < 0)]
        if not len(able):
            break
        best = able[np.argmin(np.abs(size[able] - abs(missing)))]
        if abs(abs(missing) - size[best]) >= abs(missing):
            break
        taken[best] = 1 - taken[best]
    return taken


def _fly(rows: pd.DataFrame) -> pd.DataFrame:
    """One block. If it is its source's only one, LANDING_DOCS documents, of sizes that fall geometrically from the largest
    to the smallest, stay out of the flight and land with what it leaves, large or small; else up to two fractions are
    left for the next round.
    """
    rows = rows.sort_values(["size", "doc_id", "text_hash", "row_hash"], ascending=[False, True, True, True], kind="stable")
    chance, size = rows["chance"].to_numpy(float), rows["size"].to_numpy(float)
    seed = int(rows["_block"].iloc[0]) * 1_000_003 + int(size.sum()) * 31 + len(rows)
    last = rows["_blocks"].iloc[0] == 1
    flying = np.ones(len(rows), bool)
    open_ = np.flatnonzero((chance > NEAR) & (chance < 1 - NEAR))
    if last and len(open_):
        falling = size[open_]
        wanted = np.geomspace(max(falling[0], 1.0), max(falling[-1], 1.0), LANDING_DOCS)
        near = np.searchsorted(-falling, -wanted).clip(0, len(open_) - 1) + np.arange(LANDING_DOCS)
        flying[open_[near[near < len(open_)]]] = False
    moved = chance.copy()
    moved[flying] = flight(chance[flying], size[flying], seed)
    if last:
        owed = float((chance * size).sum())
        moved = settle(landing(moved, size, owed), size, open_, owed)
    return rows.assign(chance=moved)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most_repeats: float = 3.0, block_docs: int = 4096) -> DataFrame:
    """One row per document: doc_id, source, text_hash, size, source_size, target, copies, taken = copies * size; and
    row_hash, over all columns and their nulls, by which a row is found again.
    """
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")
    sized = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), _row_hash(docs).alias("row_hash"), size.alias("size")))
    goals = materialise(targets(sized, weights, share, most_repeats))
    goal = goals.withColumnRenamed("source", "_source")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    due = F.when(F.abs(due - F.round(due)) < 1e-7, F.round(due)).otherwise(due)
    rows = sized.join(goal, sized["source"].eqNullSafe(goal["_source"])).drop("_source")
    rows = rows.withColumn("whole", F.floor(due).cast("int")).withColumn("chance", due - F.floor(due))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", _blocks bigint, _block bigint"

    done: list[DataFrame] = []
    left = rows
    while True:
        counted = left.groupBy("source").agg(F.ceil(F.count("*") / block_docs).cast("bigint").alias("_blocks")).withColumnRenamed("source", "_source")
        last = not counted.where("_blocks > 1").limit(1).count()
        blocked = left.join(counted, left["source"].eqNullSafe(counted["_source"])).drop("_source")
        # The row number spreads repeated rows over the blocks; such rows are alike, so any of them may get any number.
        row = F.row_number().over(Window.partitionBy("row_hash").orderBy("size"))
        blocked = blocked.withColumn("_row", row).withColumn("_block", F.pmod(F.xxhash64("row_hash", "_row"), "_blocks")).drop("_row")
        flown = materialise(blocked.groupBy("source", "_block").applyInPandas(_fly, schema).drop("_block", "_blocks"))
        if last:
            done.append(flown)
            break
        is_open = (F.col("chance") > NEAR) & (F.col("chance") < 1 - NEAR)
        done.append(flown.where(~is_open))
        left = flown.where(is_open)
    taken = done[0]
    for more in done[1:]:
        taken = taken.unionByName(more)
    copies = (F.col("whole") + F.round("chance")).cast("bigint")
    return taken.select("doc_id", "source", "text_hash", "row_hash", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most_repeats: float = 3.0) -> DataFrame:
    """The documents of the mix with their own columns: each as often as it is taken. Rows alike in every column are one
    document that is taken as often as all of them together.
    """
    chosen = mix(docs, weights, share, most_repeats)
    chosen = chosen.groupBy(F.col("row_hash").alias("_mix_row_hash")).agg(F.sum("copies").alias("_mix_copies")).where("_mix_copies > 0")
    one = docs.groupBy(_row_hash(docs).alias("_mix_hash")).agg(F.first(F.struct(*[F.col(c) for c in docs.columns])).alias("_mix_row"))
    many = one.join(chosen, one["_mix_hash"] == chosen["_mix_row_hash"]).select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))).alias("_mix_copy"))
    return many.select(*[F.col("_mix_row")[c].alias(c) for c in docs.columns])


def _row_hash(docs: DataFrame):
    """64 bits over every column, and over which of them are null, as a hash passes over nulls."""
    return F.xxhash64(*[F.col(c) for c in docs.columns], F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in docs.columns]))

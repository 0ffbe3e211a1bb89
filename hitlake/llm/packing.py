"""Best-fit packing: token pieces of at most `capacity` ids into as few sequences as possible.

A document is its token ids and an end id. Longer ones are cut into full pieces, the first one taking the remainder.
Pieces are dealt by hash into blocks of a bounded number of pieces, and each block is packed by bin completion, a
branch-and-bound search: around the largest piece left, undominated fillings of the rest of the sequence, of any
number of pieces, are tried fullest first; a branch whose waste already exceeds what a better packing may waste is cut.
Best-fit decreasing or a greedy packing gives the first best known packing, and the search stops at the lower bound (by
total length, and by the most pieces a sequence can hold) or after `search_nodes` nodes, keeping the best packing so far
(valid in any case). Only lengths are packed; the ids meet their places in one join afterwards.

What a block loses on its own, a sequence that the other blocks' leftovers would have filled, is made good in rounds:
sequences that are not full meet again in new blocks, each sequence as a whole, so that their packing so far is the one to
beat, until they are one block. A block among several needs no search within one sequence of its bound for this reason;
the last block is searched in full.

Defined cases: null text = empty text (one piece, the end id); repeated rows are packed one by one; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitlake.llm.common import materialise, texts

#: White space in the sense of the tokenizer's pattern language (Unicode property White_Space).
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The pre-tokenizing pattern of byte-level BPE files of this family (a fixed value).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

MOST_SENT = 1_000_000  # keys of 8 bytes
DOCUMENTS = 250  # whose ids a task holds at once
MOST_TASKS = 20_000  # with more blocks than that a task packs several, one after the other


class Encoder:
    """Ids of a byte-level BPE vocabulary file, those of the `tokenizers` library's `encode` without special tokens added.

    The file is read with that library; `tiktoken` applies it, three times as fast, with the same ids (tests hold one
    against the other). A text that spells an added token of the file goes through the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        vocabulary = self.exact.get_vocab(with_added_tokens=False)
        shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token)}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> list[int]:
        if any(token in text for token in self.added):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast(text)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return array.array("I", self.encode(text)).tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32): every document cut into pieces; ids are little-endian 32-bit integers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(tokenizer_path), array.array("I", [end_id]).tobytes()
        names = ["doc_id", "piece", "start", "length", "ids"]
        for batch in (whole.slice(lo, DOCUMENTS) for whole in batches for lo in range(0, whole.num_rows, DOCUMENTS)):
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids = encoder.ids(text) + end
                n = len(ids) // 4
                at, head = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    stop = min(n, at + (head if piece == 0 else capacity))
                    for column, value in zip(rows, (doc_id, piece, at, stop - at, ids[4 * at : 4 * stop])):
                        column.append(value)
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:4]), pa.array(rows[4], pa.binary())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut_up = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")
    return cut_up.withColumn("ids_crc32", F.crc32("ids"))


# ---------------------------------------------------------------- packing one block


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing over lengths sorted in descending order; the bins as lists of lengths."""
    by_room: dict[int, list[list[int]]] = {}
    rooms = 0  # bit r is set if some bin has room r
    bins = []
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            room = length + ((fitting & -fitting).bit_length() - 1)
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, []
            bins.append(chosen)
        chosen.append(length)
        left = room - length
        if left:
            if not by_room.setdefault(left, []):
                rooms |= 1 << left
            by_room[left].append(chosen)
    return bins


def fillings(counts: list[int], present: int, room: int, top: int) -> Iterator[tuple[int, ...] | None]:
    """Undominated ways to fill `room` beside one piece of the largest length `top`, of any number of pieces, fullest first, one at a time.

    A filling is dominated if a piece left over fits into its waste or could take the place of a shorter piece of it;
    None stands for each of those, so that the caller can count them. The sums that the pieces up to each length can
    reach are worked out first, so every branch of the enumeration ends in a filling. The counts must be those of the
    call whenever the next filling is asked for.
    """
    if room > 0 and counts[room] > (room == top):
        yield (room,)  # a piece that fills the room dominates every other filling
        return
    mask = (1 << (room + 1)) - 1
    free, lengths, left = {}, [], present & mask if room > 0 else 0
    while left:
        low = left & -left
        x = low.bit_length() - 1
        if counts[x] > (x == top):
            lengths.append(x)
            free[x] = counts[x] - (x == top)
        left ^= low
    usable = sum(1 << x for x in lengths)
    reach = [1]  # bit s of reach[k]: the k shortest lengths can add up to s
    for x in lengths:
        sums = reach[-1]
        for _ in range(min(free[x], room // x)):
            wider = sums | (sums << x) & mask
            if wider == sums:
                break
            sums = wider
        reach.append(sums)

    def dominated(filling: tuple[int, ...], waste: int) -> bool:
        over = usable  # bit y is set if a piece of length y is left over
        for x in filling:
            if free[x] == filling.count(x):
                over &= ~(1 << x)
        near = (1 << waste) - 1
        return bool(over >> 1 & near) or any(over >> (x + 1) & near for x in filling)

    for total in range(room, -1, -1):
        if not reach[-1] >> total & 1:
            continue
        # Longest pieces first: (lengths still usable, sum still missing, pieces taken).
        stack: list[tuple[int, int, tuple[int, ...]]] = [(len(lengths), total, ())]
        while stack:
            k, missing, taken = stack.pop()
            if not missing:
                yield None if total < room and dominated(taken, room - total) else taken
                continue
            while k and not reach[k - 1] >> missing & 1 and lengths[k - 1] > missing:
                k -= 1
            x = lengths[k - 1]
            for n in range(min(free[x], missing // x) + 1):  # most pieces of the longest length come off the stack first
                if reach[k - 1] >> (missing - n * x) & 1:
                    stack.append((k - 1, missing - n * x, taken + (x,) * n))


def near_filling(counts: list[int], present: int, room: int) -> tuple[int, ...]:
    """A full filling of up to four pieces that begins with one of the longest: quick, for a first packing only."""

    def largest(limit: int, used: tuple[int, ...] = ()) -> int:
        below = present & ((1 << (limit + 1)) - 1) if limit > 0 else 0
        while below:
            top = below.bit_length() - 1
            if counts[top] > used.count(top):
                return top
            below ^= 1 << top
        return 0

    found: dict[tuple[int, ...], int] = {}
    first = largest(room)
    if not first:
        return ()
    if first == room:
        return (room,)
    tried = 0
    while first and tried < 24:
        tried += 1
        second = largest(room - first, (first,))
        filling = (first, second) if second and second <= first else (first,)
        if sum(filling) < room and second:
            third = largest(room - sum(filling), filling)
            if third and third <= filling[-1]:
                filling = (*filling, third)
                fourth = largest(room - sum(filling), filling)
                if fourth:
                    filling = (*filling, fourth)
        found[tuple(sorted(filling, reverse=True))] = sum(filling)
        if sum(filling) == room:
            break
        first = largest(first - 1)
    return min(found, key=lambda f: (-found[f], len(f), tuple(-x for x in f)))


def near_fit(order: list[int], capacity: int) -> list[list[int]]:
    """A packing that gives the longest piece left a `near_filling`, again and again."""
    counts = [0] * (capacity + 1)
    for x in order:
        counts[x] += 1
    present = sum(1 << x for x in range(1, capacity + 1) if counts[x])
    bins = []
    while present:
        bin_: list[int] = []
        for part in (lambda: (present.bit_length() - 1,), lambda: near_filling(counts, present, capacity - bin_[0])):
            taken = part()
            for x in taken:
                counts[x] -= 1
                if not counts[x]:
                    present ^= 1 << x
            bin_ += taken
        bins.append(bin_)
    return bins


def lower_bound(order: list[int], capacity: int) -> int:
    """Sequences needed at least: by the sum of the lengths, and by the most pieces that one sequence can hold."""
    room, most = capacity, 0
    for x in reversed(order):
        room -= x
        if room < 0:
            break
        most += 1
    return max(-(-sum(order) // capacity), -(-len(order) // max(1, most)))


def pack(lengths: list[int], capacity: int, search_nodes: int = 20_000, known: list[list[int]] | None = None, slack: int = 0) -> list[list[int]]:
    """Bins of lengths: bin completion from the best of `known`, best-fit decreasing and `near_fit`; a packing within
    `slack` sequences of the lower bound is good enough.
    """
    order = sorted(lengths, reverse=True)
    best = min(([known] if known else []) + [best_fit(order, capacity)], key=len)
    total = sum(order)
    bound = lower_bound(order, capacity) + slack
    if len(best) <= bound or not order:
        return best
    best = min(best, near_fit(order, capacity), key=len)
    counts = [0] * (capacity + 1)
    for x in order:
        counts[x] += 1
    present = sum(1 << x for x in range(1, capacity + 1) if counts[x])
    nodes = 0
    path: list[tuple[int, ...]] = []
    waste = 0

    def take(bin_: tuple[int, ...], sign: int) -> None:
        nonlocal present
        for x in bin_:
            counts[x] -= sign
            present = present | (1 << x) if counts[x] else present & ~(1 << x)

    # Depth-first with an explicit stack: (fillings still to try around the largest piece, that piece).
    stack: list[tuple[int, Iterator[tuple[int, ...] | None]]] = []

    def descend() -> None:
        stack.append((top := present.bit_length() - 1, fillings(counts, present, capacity - top, top)))

    descend()
    while stack and nodes < search_nodes and len(best) > bound:
        top, options = stack[-1]
        rest = next(options, False)
        if rest is None:
            nodes += 1
            continue
        spent = 0 if rest is False else capacity - top - sum(rest)
        # Fillings come fullest first: once one wastes more than any packing with fewer sequences may, so do all others.
        if rest is False or waste + spent > (len(best) - 1) * capacity - total:
            stack.pop()
            if path:
                undone = path.pop()
                take(undone, -1)
                waste -= capacity - sum(undone)
            continue
        bin_ = (top, *rest)
        nodes += 1
        take(bin_, 1)
        path.append(bin_)
        waste += spent
        if present:
            descend()
        else:
            if len(path) < len(best):
                best = [list(b) for b in path]
            undone = path.pop()
            take(undone, -1)
            waste -= spent
    return best


def _place(capacity: int, single: bool, slack: int):
    """Packs one block of (_key, _copy, length, _seq, _at): a whole block of pieces if `_seq` is null, else of sequences."""

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_key", "_copy"], ascending=[False, True, True], kind="stable")
        lengths, block = rows["length"].tolist(), int(rows["_block"].iloc[0])
        known = None if rows["_seq"].isna().all() else [g.tolist() for _, g in rows.groupby("_seq")["length"]]
        found = pack(lengths, capacity, known=known, slack=0 if single else slack)
        if known is not None and len(found) == len(known):
            return rows.drop(columns="_block").assign(_room=capacity - rows.groupby("_seq")["length"].transform("sum"))
        at: dict[int, list[int]] = {}
        for i, x in enumerate(lengths):
            at.setdefault(x, []).append(i)
        sequence, offset, room = (np.zeros(len(rows), np.int64) for _ in range(3))
        for number, bin_ in enumerate(found):
            begin = 0
            for x in bin_:
                i = at[x].pop()
                sequence[i], offset[i], room[i] = block + number, begin, capacity - sum(bin_)
                begin += x
        return rows.drop(columns="_block").assign(_seq=sequence, _at=offset, _room=room)

    return place


def place_lengths(rows: DataFrame, capacity: int = 1024, block_pieces: int = 8192) -> DataFrame:
    """(_key, _copy, length, _seq, _at) from (_key, _copy, length): each piece's sequence and its place there.

    A round deals pieces, later whole sequences that are not full, into blocks of about `block_pieces` pieces or an eighth
    as many sequences. Rounds end with one block, or when over three quarters of a round's total length would come again:
    then the lengths leave room everywhere, and another deal gains little. `rows` is read several times: a written table.
    A block's sequence numbers begin with 2**20 times its own number over all rounds, and it holds fewer sequences.
    """
    kind = "_key bigint, _copy int, length bigint, _seq bigint, _at bigint, _room bigint"
    left = rows.selectExpr("_key", "_copy", "length", "CAST(NULL AS bigint) AS _seq", "CAST(NULL AS bigint) AS _at")
    dealt_by, first, done = F.xxhash64("_key", "_copy"), 0, []
    blocks = max(1, -(-rows.count() // block_pieces))
    while True:
        numbered = left.withColumn("_block", (F.pmod(dealt_by, F.lit(blocks)) + first) * F.lit(1 << 20))
        # Dealt by range, so that tasks hold blocks evenly, not as many as happen to hash together.
        dealt = numbered.repartitionByRange(min(blocks, MOST_TASKS), "_block")
        packed = materialise(dealt.groupBy("_block").applyInPandas(_place(capacity, blocks == 1, 1), kind))
        again = packed.where("_room > 0")
        more, part, whole = packed.selectExpr("count_if(_room > 0 AND _at = 0)", "sum(if(_room > 0, length, 0))", "sum(length)").first() if blocks > 1 else (0, 0, 0)
        if not more or 4 * part > 3 * whole:
            done.append(packed)
            break
        done.append(packed.where("_room = 0"))
        left, dealt_by, first = again.drop("_room"), F.xxhash64("_seq"), first + blocks
        blocks = max(1, -(-more * 8 // block_pieces))
    return reduce(DataFrame.unionByName, done).drop("_room")


def pack_pieces(cut: DataFrame, capacity: int = 1024, block_pieces: int = 8192) -> DataFrame:
    """Add sequence_id and offset to pieces, a written table, ids and all.

    Pieces alike in id, place and content are numbered, so that many copies spread over the blocks too; which of them
    gets which number makes no difference. So the packing depends on the pieces alone, not on their order or files.
    """
    same = ["doc_id", "piece", "ids_crc32"]
    keys = F.xxhash64(*same, F.col("doc_id").isNull())
    many = materialise(cut.groupBy(keys.alias("_many")).agg(F.count("*").alias("_n")).where("_n > 1").select("_many"))
    marked = cut.withColumn("_key", keys)
    many = F.broadcast(many) if many.count() <= MOST_SENT else many  # numbers only; more of them meet the pieces in a shuffle
    once, again = (marked.join(many, marked["_key"] == many["_many"], how).drop("_many") for how in ("left_anti", "left_semi"))
    numbered = F.row_number().over(Window.partitionBy("_key").orderBy("length")) - 1
    light = once.select("_key", F.lit(0).alias("_copy"), "length").unionByName(again.select("_key", numbered.alias("_copy"), "length"))
    placed = place_lengths(materialise(light), capacity, block_pieces).select("_key", "_copy", F.col("_seq").alias("sequence_id"), F.col("_at").alias("offset"))
    keyed = once.withColumn("_copy", F.lit(0)).unionByName(again.withColumn("_copy", numbered))
    return keyed.join(placed, ["_key", "_copy"]).select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset."""
    return pack_pieces(materialise(pieces(docs, tokenizer_path, capacity)), capacity)

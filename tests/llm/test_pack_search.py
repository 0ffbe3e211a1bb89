"""Bin completion over fillings of any number of pieces."""

import itertools
import random

from hitlake.llm import packing as P


def brute_fillings(pieces, room):
    """Undominated sums of sub-multisets, by trying all of them."""
    found = set()
    for n in range(len(pieces) + 1):
        for at in itertools.combinations(range(len(pieces)), n):
            chosen = [pieces[i] for i in at]
            rest = [pieces[i] for i in range(len(pieces)) if i not in at]
            waste = room - sum(chosen)
            if waste >= 0 and not any(x < y <= x + waste for x in [0, *chosen] for y in rest):
                found.add(tuple(sorted(chosen, reverse=True)))
    return found


def test_fillings_are_complete_and_fullest_first():
    rng = random.Random(4)
    for _ in range(150):
        pieces = sorted((rng.randint(1, 12) for _ in range(rng.randint(0, 8))), reverse=True)
        top, room = 14, rng.randint(0, 25)
        counts = [0] * 40
        for x in [top, *pieces]:
            counts[x] += 1
        got = [f for f in P.fillings(counts, sum(1 << x for x in range(40) if counts[x]), room, top) if f is not None]
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True) and len(got) == len(set(got))
        want = brute_fillings(pieces, room)
        assert set(got) == ({(room,)} if room in pieces else want)


def test_six_pieces_in_a_sequence():
    rng = random.Random(2)
    lengths = [rng.randint(150, 180) for _ in range(2048)]
    bins = P.pack(lengths, 1024)
    assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= 1024 for b in bins)
    assert len(bins) < len(P.best_fit(sorted(lengths, reverse=True), 1024))
    assert len(bins) == P.lower_bound(sorted(lengths, reverse=True), 1024)


def test_a_known_packing_is_the_one_to_beat():
    hard = [4, 4, 4, 3, 3, 3, 3, 3, 3]  # best fit: 4+4 | 4+3+3 | 3+3+3 | 3
    known = [[4, 3, 3], [4, 3, 3], [4, 3, 3]]
    assert P.pack(hard, 10, known=known) == known
    assert len(P.pack(hard, 10, known=[[x] for x in hard])) == 3


def test_leftovers_of_blocks_meet_again(spark):
    """Blocks that each leave a sequence half full, against one block; every place is taken once and without gaps."""
    rng = random.Random(6)
    for low, high in ((1, 40), (150, 180), (200, 1024), (1024, 1024)):
        lengths = [rng.randint(low, high) for _ in range(1500)]
        rows = spark.createDataFrame([(i // 2, i % 2, x) for i, x in enumerate(lengths)], "_key bigint, _copy int, length bigint")
        rows = P.materialise(rows)
        got = P.place_lengths(rows, block_pieces=400).collect()
        assert sorted((r["_key"], r["_copy"], r["length"]) for r in got) == [(i // 2, i % 2, x) for i, x in enumerate(lengths)]
        bins = {}
        for r in sorted(got, key=lambda r: (r["_seq"], r["_at"])):
            assert r["_at"] == bins.get(r["_seq"], 0)
            bins[r["_seq"]] = r["_at"] + r["length"]
        assert max(bins.values()) <= 1024
        again = {(r["_key"], r["_copy"]): (r["_seq"], r["_at"]) for r in P.place_lengths(rows.repartition(5), block_pieces=400).collect()}
        assert again == {(r["_key"], r["_copy"]): (r["_seq"], r["_at"]) for r in got}
        if high <= 40:  # small pieces fill every gap: all blocks together reach the bound
            assert len(bins) == P.lower_bound(sorted(lengths, reverse=True), 1024)
        else:
            assert len(bins) <= 1.02 * len(P.pack(lengths, 1024)) + 1

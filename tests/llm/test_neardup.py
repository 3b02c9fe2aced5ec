import itertools
import random
import re

import numpy as np
import pyarrow as pa

from graphloom.llm import neardup, textkernel
from graphloom.llm.components import components
from graphloom.llm.scratch import Scratch
from tests.llm.data import documents, frame, prose


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """{id: (size, smallest linked id)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            low[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def check(spark, rows):
    want = brute(rows)
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_equals_brute_force(spark):
    check(spark, documents())


def test_chain_of_borderline_copies(spark):
    rng = random.Random(5)
    words = prose(rng, 120).split()
    rows = [(0, " ".join(words))]
    for i in range(1, 40):
        if i % 3 == 0:
            words = rows[rng.randrange(len(rows))][1].split()
        words[rng.randrange(len(words))] = f"w{i}"
        words[rng.randrange(len(words))] = f"v{i}"
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    check(spark, rows)


def test_empty_table_and_deduplicate(spark):
    assert neardup.near_duplicates(frame(spark, [])).collect() == []
    rows = documents()
    want = brute(rows)
    docs = frame(spark, rows)
    got = neardup.deduplicate(docs)
    assert got.columns == docs.columns
    ids = sorted((r.doc_id for r in got.collect()), key=lambda i: (i is None, i))
    assert ids == [*sorted(i for i, (_, c) in want.items() if i == c), None]


def test_kernel_shingles_equal_sets():
    texts = [t for _, t in documents()]
    data, offsets = textkernel.byte_view(pa.array(texts))
    for limit in (1, 1000, 1 << 22):
        sizes = []
        for _, _, part, offs in textkernel.blocks(data, offsets, limit):
            sizes += np.diff(textkernel.shingles(part, offs)[1]).tolist()
        assert sizes == [len(shingles(t)) for t in texts]


def test_circulant_coordinates_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = np.concatenate((a[:3000], rng.integers(0, 1 << 63, 1000, dtype=np.uint64)))
    sig = neardup.circulant(np.concatenate((a, b)), np.array([0, 4000, 8000]), 2048)
    assert abs((sig[:, 0] == sig[:, 1]).mean() - 3000 / 5000) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 201), (202, 200)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()
    assert dict(got) == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200} and len(got) == 56
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").collect() == []


def test_hot_buckets_are_cut_into_cells(spark, monkeypatch):
    """Many classes that share a passage, most of them too far apart: cells of any size give the same."""
    rng = random.Random(12)
    shared = prose(rng, 100).split()
    rows = [(i, " ".join(shared + prose(rng, rng.choice([20, 40, 60])).split())) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more words at the end") for i in range(20)]
    for cell in (3, 2000):
        monkeypatch.setattr(neardup, "CELL", cell)
        check(spark, rows)


def test_texts_of_one_id_are_kept(spark):
    rng = random.Random(13)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (1, b), (1, a), (2, a), (None, a), (None, a)]
    kept = neardup.deduplicate(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, a), (1, b), (0, a), (0, a)])


def test_different_texts_of_one_id(spark):
    rng = random.Random(9)
    words = lambda: [f"{rng.choice('bcdfg')}{rng.randrange(10**6)}" for _ in range(60)]
    a, b = words(), words()
    near = lambda w: " ".join([*w[:-1], "last"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (9, near(b)), (4, near(near(b).split()))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect())
    assert got == [(4, 4, True), (5, 4, False), (5, 5, True), (7, 5, False), (9, 4, False)]


def test_random_tables_with_repeated_ids(spark):
    rng = random.Random(21)
    base = [[f"{rng.choice('bcdfg')}{rng.randrange(10**6)}" for _ in range(50)] for _ in range(4)]
    rows = []
    for _ in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(50)] = f"x{rng.randrange(40)}"
        rows.append((rng.randrange(25), " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    low = list(range(len(rows)))
    for _ in rows:
        for x, y in itertools.combinations(range(len(rows)), 2):
            if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                low[x] = low[y] = min(low[x], low[y])
    least = {c: min(rows[i][0] for i in range(len(rows)) if low[i] == c) for c in set(low)}
    want = sorted((rows[i][0], len(sets[i]), least[low[i]]) for i in range(len(rows)))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, rows)).collect()) == want
    kept = sorted((r.doc_id, r.text) for r in neardup.deduplicate(frame(spark, rows)).collect())
    assert kept == sorted({(rows[i][0], rows[i][1]) for i in range(len(rows)) if rows[i][0] == least[low[i]]})

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from crashrisk.llm import jaccard_join
from crashrisk.llm.components import components
from crashrisk.llm.jaccard_join import Scheme, one_of_each, op2, similar_classes
from tests.llm.conftest import EDGES, LOWER, WORD


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(words)] if 0 < len(words) < k else [tuple(words[i:i + k]) for i in range(len(words) - k + 1)])


def brute(rows, k, num, den):
    """[(key, set size, smallest key of the component)], by comparing all pairs of different sets."""
    classes = defaultdict(list)
    for key, text in rows:
        classes[shingles(text, k)].append(key)
    sets = [s for s in classes if s]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for other, shared in Counter(j for gram in s for j in where[gram]).items():
            if den * shared >= num * (len(s) + len(sets[other]) - shared):
                root[find(other)] = find(i)
        for gram in s:
            where[gram].append(i)
    keys = defaultdict(list)
    for i, s in enumerate(sets):
        keys[find(i)] += [k for k in classes[s] if k is not None]
    low = {s: min(keys[find(i)], default=None) for i, s in enumerate(sets)}
    return Counter((key, len(shingles(text, k)), low.get(shingles(text, k), key)) for key, text in rows)


def result(frame):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect())


def mutated(seed, n_groups=12, copies=25, size=60):
    """Texts in groups of near copies with 0 to 12 changed words, common passages, and small sets."""
    rng, rows = random.Random(seed), []
    passage = [f"common{i}" for i in range(40)]
    for g in range(n_groups):
        base = [f"w{g}x{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(13)):
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [words[at], f"n{rng.randrange(10**6)}"]])
            if g % 3 == 0:
                words = passage + words
            rows.append((len(rows), " ".join(words)))
    for n in range(1, 40):
        words = [f"s{n}y{i}" for i in range(n)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:-1] + ["other"])), (len(rows) + 2, " ".join([*words, "more"]))]
    return rows


def test_documents(spark, sf_dir, document_rows):
    assert result(op2(spark, sf_dir)) == brute(document_rows, 3, 90, 100)


@pytest.mark.parametrize("k, num, den", [(5, 80, 100), (3, 90, 100), (2, 60, 100)])
def test_near_copies(spark, monkeypatch, k, num, den):
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", 20)  # so that the passage counts as hot
    rows = mutated(k)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(similar_classes(frame, words=k, num=num, den=den)) == brute(rows, k, num, den)


def test_values_of_many_classes_meet_neighbours_of_other_flushes(monkeypatch):
    """What a flush sends out as rows still meets a class that another one holds as a neighbour only."""
    monkeypatch.setattr(jaccard_join, "DIRECT_CLASSES", 2)
    value = 12345 << 20

    def flush(classes):
        """The packed rows of classes that show one value, (class, is it a neighbour)."""
        n = len(classes)
        batch = pa.record_batch({"cid": pa.array([c for c, _ in classes], pa.int64()), "need": pa.array([1] * n, pa.int64())}
                                | {"band0": pa.array([0] * n, pa.int32()), "codes0": pa.array([[int(near)] for _, near in classes], pa.list_(pa.int32())),
                                   "values0": pa.array([[value]] * n, pa.list_(pa.int64()))}
                                | {"band1": pa.array([0] * n, pa.int32()), "codes1": pa.array([[]] * n, pa.list_(pa.int32())),
                                   "values1": pa.array([[]] * n, pa.list_(pa.int64()))})
        return list(jaccard_join._packed(iter([batch]), {0: np.array([0, 1])}, 1))

    for flushes in ([[(1, True), (2, True), (3, False)], [(4, True)], [(5, True), (6, True)]],
                    [[(1, True), (2, True), (3, True)], [(4, False)], [(5, True), (6, True), (7, True)]]):
        packed = [batch for classes in flushes for batch in flush(classes)]
        met = {(r["cid"], r["exact"]) for batch in jaccard_join._members(iter(packed)) for r in batch.to_pylist()}
        assert {c for c, _ in met} == {c for classes in flushes for c, _ in classes}
        assert {c for c, exact in met if exact} == {c for classes in flushes for c, near in classes if not near}


def test_edges(edges):
    assert result(similar_classes(edges, words=3, num=90, den=100)) == brute(EDGES, 3, 90, 100)


def test_empty_table(nothing):
    assert similar_classes(nothing).count() == 0


def test_one_of_each(spark, edges):
    got = Counter((r["doc_id"], r["text"]) for r in one_of_each(edges).collect())
    assert got == Counter(set(EDGES))
    rows = mutated(9)
    kept = {r["doc_id"] for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {low for _, _, low in brute(rows, 5, 80, 100)}


def test_bounds():
    """No two similar sizes differ by more than the bound of either."""
    for num, den in ((80, 100), (90, 100), (1, 2)):
        scheme, n = Scheme(num, den), np.arange(1, 400)
        for a in n:
            b = np.arange(a, scheme.largest(a) + 1)
            # the most elements two sets of a and b elements differ in at a similarity of num / den or more
            shared = -(-num * (a + b) // (num + den))
            worst = np.where(shared <= a, a + b - 2 * shared, 0)
            assert (worst <= scheme.differences(a)).all() and (worst <= scheme.differences(b)).all()
            assert (scheme.band(b) <= scheme.band(a) + 1).all()


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_shown_values_go_before_sets_are_compared(spark, monkeypatch):
    # they are the largest table; keeping them to the end was the peak of disk
    gone = []
    monkeypatch.setattr(jaccard_join, "_labels", lambda *a, real=jaccard_join._labels: (gone.append(len(removed)), real(*a))[1])
    removed = []
    monkeypatch.setattr(jaccard_join, "discard", lambda *t, real=jaccard_join.discard: (
        removed.extend(x.stored_at for x in t if x is not None and "/profiles-" in x.stored_at), real(*t))[1])
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words stand in this one here"), (4, None)]
    got = similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=90, den=100)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert gone == [1]


def test_only_sets_that_may_be_similar_are_fetched(spark, monkeypatch):
    # long texts with a long passage in common share shown values; sketches of one length for all tell them apart no more
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(1800)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(1200))])) for i in range(8)]
    rows.append((8, rows[3][1] + " and one more"))
    seen = defaultdict(list)
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name, *a, real=jaccard_join.stored: (
        out := real(df, name, *a), seen[name].append(out.count()))[0])
    got = similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {**{i: i for i in range(8)}, 8: 3}
    assert sum(seen["compared"]) == 1 and sum(seen["sets"]) == 2
    monkeypatch.setattr(jaccard_join, "BROADCAST_CLASSES", 0)
    assert {r["doc_id"]: r["component_id"] for r in similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}[8] == 3


def test_long_sketches_differ_in_no_more_bits_than_their_sets():
    rng = np.random.default_rng(6)
    for a, b, both in ((600, 700, 500), (513, 5000, 400), (3000, 3000, 2900), (100, 900, 90), (1024, 1025, 1024)):
        tokens = np.unique(rng.integers(0, 1 << 62, a + b - both).astype(np.uint64))
        one, two = tokens[:a], tokens[a - both:]
        sketches = [jaccard_join._long_sketches(t, np.array([0, len(t)]))[0] for t in (one, two)]
        assert [8 * len(s) >= len(t) for s, t in zip(sketches, (one, two))] == [len(t) > 64 * jaccard_join.SKETCH for t in (one, two)]
        for num, den in ((80, 100), (90, 100), (1, 2)):
            pair = pa.record_batch([pa.array([1]), pa.array([2]), pa.array([a + b]), *(pa.array([s], pa.binary()) for s in sketches)],
                                   names=["a", "b", "total", "a_long", "b_long"])
            kept = next(jaccard_join._possible(iter([pair]), num, den)).num_rows
            assert kept or den * both < num * (a + b - both)

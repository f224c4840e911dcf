import itertools
import random

from pyspark.sql import functions as F

from crashrisk.llm import filter_audit as A
from tests.llm.conftest import EDGES, WORD

LABELS = [(1, 1, 0), (5, 0, 1), (5, 1, 0), (7, None, 1), (None, 1, 1)]


def fails(rows):
    """(part, mask, key) of rows (key, text, part)."""
    for key, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        copy = key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows)
        flags = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
                 any(c in "#$%&*|" for c in text), copy]
        yield part or "", sum(f << i for i, f in enumerate(flags)), key


def brute(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    masks = list(fails(rows))
    out = {}
    for part in {p for p, _, _ in masks}:
        mine = [(m, k) for p, m, k in masks if p == part]
        shapley = dict.fromkeys(range(5), 0)
        for order in itertools.permutations(range(5)):
            gone = 0
            for step, f in enumerate(order, 1):
                out_now = [(m, k) for m, k in mine if not m & gone and m >> f & 1]
                gone |= 1 << f
                shapley[f] += len(out_now)
                out[part, "".join("ABCDE"[i] for i in order), step] = [
                    f, sum(not m & gone for m, _ in mine), len(out_now), sum(m >> f & 1 for m, _ in mine) - len(out_now),
                    sum(m == 1 << f for m, _ in mine), sum(k in good for _, k in out_now), sum(k in toxic for _, k in out_now)]
        for (p, _, _), v in out.items():
            if p == part:
                v.append(shapley[v[0]])
    return {k: v[1:] for k, v in out.items()}


def figures(df):
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in A._FIGURES] for r in df.collect()}
    assert df.columns == ["part", "filter_order", "step", *A._FIGURES]
    return got


def test_query_equals_brute_force(spark, sf_dir, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert figures(A.op12(spark, sf_dir)) == brute(rows, labels)


def test_edges(spark, edges):
    frame = edges.withColumn("source", F.when(F.col("doc_id") > 4, "a")).withColumn("mask", F.lit(1))
    rows = [(k, t, "a" if k is not None and k > 4 else None) for k, t in EDGES]
    rows += [(9, "", "a"), (10, None, "b"), (11, EDGES[0][1], "b")]
    more = spark.createDataFrame(rows[len(EDGES):], "doc_id long, text string, source string")
    frame = frame.select("doc_id", "text", "source").unionByName(more)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert figures(A.interaction_audit(A.document_masks(frame, labels), "ABCDE")) == brute(rows, LABELS)


def test_diagram_in_every_order():
    rng = random.Random(5)
    for n in (1, 2, 3, 6):
        counts = {m: (rng.randrange(4), rng.randrange(3)) for m in range(1 << n) if rng.random() < 0.7}
        diagram, met = A.Diagram(counts, n, 2), set()
        for swap in [None, *A.neighbour_swaps(n)]:
            if swap is not None:
                diagram.swap(swap)
            met.add(tuple(diagram.order))
            gone = 0
            for f, kept, removed in diagram.steps():
                assert list(removed) == [sum(v[i] for m, v in counts.items() if not m & gone and m >> f & 1) for i in (0, 1)]
                gone |= 1 << f
                assert list(kept) == [sum(v[i] for m, v in counts.items() if not m & gone) for i in (0, 1)]
            assert all(len(set(level)) == len(level) for level in diagram.levels)  # equal nodes are one
        assert met == set(itertools.permutations(range(n)))


def test_empty_table(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.interaction_audit(A.document_masks(nothing, labels), "ABCDE").count() == 0

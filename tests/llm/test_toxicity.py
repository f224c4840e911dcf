import random
import zlib
from collections import Counter

import numpy as np

from crashrisk.llm import toxicity
from crashrisk.llm.toxicity import Model, drop_toxic_rows, features, fit, learn_toxicity, op7, score_toxicity
from tests.llm.conftest import EDGES


def test_held_out_quality(spark):
    """Labels of the fifth that is held out, which fitting never sees."""
    sf_dir = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op7(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    known = [(r["score"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    pairs = [(p > n) + 0.5 * (p == n) for p, t in known if t for n, u in known if not u]
    assert np.mean(pairs) > 0.8  # some forty confirmed texts are all there is to learn from
    assert np.mean([(s >= 0.5) == t for s, t in known]) > 0.85


def test_learns_from_positive_and_unlabelled():
    rng = random.Random(5)
    plain = [" ".join(f"w{rng.randrange(300)}" for _ in range(60)) for _ in range(3000)]
    marked = [t + f" awful{rng.randrange(5)} nasty{rng.randrange(5)}" for t in plain]
    text = lambda t: features([t.encode()])[0]
    # a tenth of the unlabelled texts are toxic, too
    model = fit([text(t) for t in marked[:300]], [text(t) for t in marked[300:400] + plain[400:1300]], 0.1)
    numbers, bounds = features([t.encode() for t in marked[2000:] + plain[2000:]])
    scores = model.scores(numbers, bounds)
    assert (scores[:1000] >= 0.5).mean() > 0.9 and (scores[1000:] >= 0.5).mean() < 0.03


def test_copies_do_not_mark_their_words():
    rng = random.Random(6)
    plain = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(1000)]
    copied = " ".join(f"c{i}" for i in range(60))
    text = lambda t: features([t.encode()])[0]
    positive = [text(t + " awful") for t in plain[:150]] + [text(copied + " awful")] * 150
    model = fit(positive, [text(t) for t in plain[150:]], 0.1)
    assert model.scores(*features([copied.encode()]))[0] < 0.5


def test_no_labels_give_the_prior(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = learn_toxicity(documents, none, default_prior=0.2)
    assert {round(r["score"], 5) for r in score_toxicity(documents, model).collect()} == {0.2}


def test_same_model_whatever_the_partitions(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    a, b = learn_toxicity(documents, labels), learn_toxicity(documents.repartition(7, "source"), labels.unionAll(labels))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_edges(edges):
    weights = np.zeros(toxicity.FEATURES, np.float32)
    model = Model(weights, -1.0)
    got = Counter((r["doc_id"], round(r["score"], 4)) for r in score_toxicity(edges, model).collect())
    assert got == Counter((k, 0.2689) for k, _ in EDGES)
    weights[features([b"word"])[0]] = 5
    kept = Counter((r["doc_id"], r["text"]) for r in drop_toxic_rows(edges, model).collect())
    assert kept == Counter(r for r in EDGES if r != (5, "word"))
    assert drop_toxic_rows(edges, model).columns == edges.columns


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    model = learn_toxicity(nothing, labels)
    assert score_toxicity(nothing, model).count() == 0 and drop_toxic_rows(nothing, model).count() == 0

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crashrisk.llm import pitman_yor as P
from crashrisk.llm import seating
from tests.llm.conftest import EDGES, LOWER, WORD

END = None


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), END]


def base(rows, held):
    """n_tokens, n_known, train_tokens and base_score of every row, by its place."""
    counts = Counter(w for (k, t) in rows if not held(k) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    for k, t in rows:
        words = tokens(t)
        yield (k, held(k), len(words), sum(w in counts for w in words), total,
               sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words))


class Restaurant:
    """Plain per-customer seating with table sizes, for a model small enough."""

    def __init__(self, d, theta, parent, rng):
        self.d, self.theta, self.parent, self.rng = d, theta, parent, rng
        self.tables, self.customers, self.n_tables = defaultdict(list), 0, 0

    def probability(self, w):
        own = self.tables.get(w, [])
        return (sum(own) - self.d * len(own) + (self.theta + self.d * self.n_tables) * self.parent.probability(w)) / (self.theta + self.customers)

    def add(self, w):
        own = self.tables[w]
        new = (self.theta + self.d * self.n_tables) * self.parent.probability(w)
        pick = self.rng.random() * (sum(own) - self.d * len(own) + new)
        for i, n in enumerate(own):
            pick -= n - self.d
            if pick < 0:
                own[i] += 1
                break
        else:
            own.append(1)
            self.n_tables += 1
            self.parent.add(w)
        self.customers += 1

    def remove(self, w):
        own = self.tables[w]
        i = self.rng.choices(range(len(own)), own)[0]
        own[i] -= 1
        self.customers -= 1
        if not own[i]:
            del own[i]
            self.n_tables -= 1
            self.parent.remove(w)


class Uniform:
    def __init__(self, n):
        self.n = n

    def probability(self, w):
        return 1 / self.n

    def add(self, w):
        pass

    def remove(self, w):
        pass


def plain_scores(rows, held, discounts, sweeps, burn_in, seed=3):
    rng = random.Random(seed)
    texts = [tokens(t) for _, t in rows]
    train = [list(zip([END, *x], x)) for (k, _), x in zip(rows, texts) if not held(k)]
    kinds = len({w for x in train for _, w in x})
    root = Restaurant(discounts[0], 1.0, Uniform(kinds + 1), rng)
    below = defaultdict(lambda: Restaurant(discounts[1], 1.0, root, rng))
    pairs = [pair for x in train for pair in x]
    for u, w in pairs:
        below[u].add(w)
    sums = Counter()
    for sweep in range(sweeps):
        for u, w in pairs:
            below[u].remove(w)
            below[u].add(w)
        if sweep >= burn_in:
            for u, w in {pair for x in texts for pair in zip([END, *x], x)}:
                sums[u, w] += below[u].probability(w) / (sweeps - burn_in)
    return [sum(math.log10(sums[u, w]) for u, w in zip([END, *x], x)) for x in texts]


def small_corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(120):
        w, text = rng.choice(words), []
        for _ in range(rng.randrange(0, 25)):
            text.append(w)
            w = words[(words.index(w) * 7 + rng.randrange(3)) % 30] if rng.random() < 0.7 else rng.choice(words)
        if i % 9 == 0:
            text.append(f"new{i}")
        rows.append((i, " ".join(text)))
    return rows


def test_tables_follow_their_law():
    """Mean and spread of the drawn numbers of tables against the recursion, below and above EXACT."""
    rng = np.random.default_rng(1)
    for c, a, p, d in ((5, 2.0, 0.3, 0.7), (100, 20.0, 0.2, 0.8), (700, 3.0, 0.5, 0.5), (700, 400.0, 0.3, 0.75), (700, 1.0, 1e-6, 0.9)):
        log = np.array([-np.inf, 0.0])
        for n in range(1, c):
            t = np.arange(1, n + 1)
            log = np.logaddexp(np.append(-np.inf, log), np.concatenate([[-np.inf], np.log(n - t * d) + log[1:], [-np.inf]]))
        t = np.arange(1, c + 1)
        law = log[1:] + np.cumsum(np.log(a + d * (t - 1))) + t * math.log(p)
        law = np.exp(law - law.max())
        law /= law.sum()
        mean, var = (t * law).sum(), (t * t * law).sum() - (t * law).sum() ** 2
        drawn = seating.reseat(np.full(4000, c), np.full(4000, a), np.full(4000, p), d, rng)
        assert abs(drawn.mean() - mean) < 0.02 * mean + 4 * math.sqrt(var / 4000)
        assert abs(drawn.var() - var) < 0.15 * var + 0.05


def test_query_counts_and_base(spark, sf_dir, document_rows):
    got = {r["doc_id"]: r for r in P.op13(spark, sf_dir).collect()}
    assert len(got) == len(document_rows)
    for k, held, n, known, total, score in base(document_rows, lambda k: zlib.crc32(str(k).encode()) % 7 == 2):
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize(("block", "bucket", "hot"), [(1 << 20, 1 << 20, 1 / 1000), (100, 20, 1 / 50)])
def test_scores_against_plain_gibbs(spark, block, bucket, hot):
    rows, held = small_corpus(), (lambda k: k % 5 == 0)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    done = P.pitman_yor_scores(frame, F.col("doc_id") % 5 == 0, burn_in=6, samples=8, block_tokens=block, bucket_tokens=bucket, hot_share=hot)
    got = {r["doc_id"]: r for r in done.collect()}
    for k, is_held, n, known, total, score in base(rows, held):
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (is_held, n, known, total)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
    # the operator's discounts: dishes that occur once and twice, the parent's with one table each
    pairs = Counter(p for k, t in rows if not held(k) for p in zip([END, *tokens(t)], tokens(t)))
    below = Counter(w for _, w in pairs)
    estimate = lambda c: min(0.9, max(0.05, (n1 := sum(v == 1 for v in c.values())) / (n1 + 2 * sum(v == 2 for v in c.values())))) if 1 in c.values() else 0.5
    want = plain_scores(rows, held, (estimate(below), estimate(pairs)), 24, 8)
    off = np.array([got[k]["score"] - s for (k, _), s in zip(rows, want)])
    size = np.array([got[k]["n_tokens"] for k, _ in rows])
    assert np.abs(off / size).max() < 0.06  # Monte Carlo error of both, in log10 a token
    assert abs(off.sum()) / size.sum() < 0.01


def test_probabilities_sum_to_one(spark):
    """Of all words, the end and one unknown word behind each context, solved from the scores of short texts."""
    rows = list(enumerate(["a b", "a b c", "b a", "c", "a a a b", "c b", ""]))
    words = ["a", "b", "c", "zz"]  # zz is never trained on
    probes = [(100 + i, t) for i, t in enumerate(["", *words, *(f"{u} {w}" for u in words for w in words)])]
    frame = spark.createDataFrame(rows + probes, "doc_id long, text string")
    scores = {r["doc_id"]: 10 ** r["score"] for r in P.pitman_yor_scores(frame, F.col("doc_id") >= 100).collect()}
    p = {t: scores[k] for k, t in probes}
    one = np.array([p[w] for w in words])  # P(w|end) P(end|w)
    two = np.array([[p[f"{u} {w}"] for w in words] for u in words]) / np.outer(one, one)  # P(w|u) / (P(end|u) P(w|end))
    ends = np.full(len(words), 0.3)  # P(end|w), from sum of P(.|w) = 1
    for _ in range(3000):
        ends = np.sqrt(ends / (1 + two @ (one / ends)))
    assert (one / ends).sum() + p[""] == pytest.approx(1, abs=1e-5)  # the sum behind the end, which nothing was solved for


def test_edges(edges):
    done = P.pitman_yor_scores(edges, F.col("doc_id") == 5, block_tokens=1000)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in done.collect()), key=repr)
    want = [r[:5] for r in base(EDGES, lambda k: k is None or k == 5)]
    assert got == sorted(want, key=repr)
    assert all(r["score"] < 0 for r in done.collect())


def test_nothing_to_learn_from(spark, nothing):
    assert P.pitman_yor_scores(nothing, F.lit(False)).count() == 0
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in P.pitman_yor_scores(frame, F.lit(True)).collect()} == {(0, 0, 0.0, 0.0)}

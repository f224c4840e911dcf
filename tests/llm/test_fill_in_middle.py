import hashlib
import re

import numpy as np
import pytest

from crashrisk.llm import fill_in_middle as M
from tests.llm.conftest import EDGES

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def brute(key, text, fim=100, spm=50, seed=7):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in M.MARKERS) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_brute_force(spark, sf_dir, document_rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in M.op11(spark, sf_dir).collect()}
    assert len(got) == len(document_rows)
    for key, text in document_rows:
        *figures, output = brute(key, text)
        assert got[key] == (*figures, sha(output), sha(text or "")), key


def test_edges(edges):
    done = M.restore_texts(M.fill_in_middle(edges))
    got = sorted((tuple(r) for r in done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()), key=repr)
    assert got == sorted(((k, *brute(k, t), t or "") for k, t in EDGES), key=repr)


@pytest.mark.parametrize(("fim", "spm"), [(0, 50), (30, 0), (70, 100)])
def test_shares_and_markers(spark, fim, spm):
    texts = ["<", "a<\n<S", "P>x\nS>\n", "x<P>y", "\n", "\n\n", "é\n日本\n\U0001f600<M", "<<P\n>", "M>", "tail<S>"]
    rows = list(enumerate(texts * 20))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    done = M.restore_texts(M.fill_in_middle(frame, fim_percent=fim, spm_percent=spm))
    got = {r["doc_id"]: r for r in done.collect()}
    for key, text in rows:
        r = got[key]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(key, text, fim, spm)
        assert r["restored"] == text


@pytest.mark.parametrize("kind", ["sparse", "dense", "runs", "mixed"])
def test_select_in_every_container(kind):
    rng = np.random.default_rng(3)
    pools = {"sparse": rng.choice(1 << 20, 3000, replace=False), "dense": rng.choice(1 << 18, 1 << 17, replace=False),
             "runs": np.concatenate([np.arange(a, a + 700) for a in range(0, 1 << 18, 1500)])}
    pools["mixed"] = np.concatenate([pools["sparse"], (1 << 21) + pools["dense"], (1 << 22) + pools["runs"]])
    values = np.unique(pools[kind])
    held = M.BoundarySet(values)
    kinds = {type(c).__name__ for c in held.containers}
    wanted = {"sparse": {"ArrayContainer"}, "dense": {"BitmapContainer"}, "runs": {"RunContainer"}}
    assert kinds == wanted.get(kind, set.union(*wanted.values()))
    for k in [0, 1, len(values) // 2, len(values) - 1, *rng.integers(0, len(values), 400)]:
        assert held.select(int(k)) == values[k]
    with pytest.raises(IndexError):
        held.select(len(values))


def test_empty_table(nothing):
    assert M.restore_texts(M.fill_in_middle(nothing)).count() == 0

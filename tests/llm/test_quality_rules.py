from collections import Counter

import pytest

from crashrisk.llm.quality_rules import op9, repetition_rules
from tests.llm.conftest import EDGES, WORD


def brute(text):
    words = WORD.findall(text or "")
    counts = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if counts[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside),
            "base_failed": len(words) < 10 or 100 * len(inside) > 20 * len(words)}


def covered(text, width):
    """Share of word characters inside n-grams that stand earlier in the text."""
    words, seen, inside = WORD.findall(text), set(), set()
    for i in range(len(words) - width + 1):
        gram = tuple(words[i:i + width])
        if gram in seen:
            inside.update(range(i, i + width))
        seen.add(gram)
    return sum(len(words[j]) for j in inside) / max(1, sum(map(len, words)))


def test_counts_and_shares(spark, sf_dir, document_rows):
    got = {r["doc_id"]: r for r in op9(spark, sf_dir).collect()}
    assert len(got) == len(document_rows)
    for key, text in document_rows:
        assert {c: got[key][c] for c in brute(text)} == brute(text), key
        for width in (5, 7, 10):
            assert got[key][f"dup_{width}"] == pytest.approx(covered(text, width)), key


def test_edges(edges):
    got = Counter((r["doc_id"], r["n_words"], r["n_repeat_words"], r["kept"]) for r in repetition_rules(edges).collect())
    want = Counter((k, brute(t)["n_words"], brute(t)["n_repeat_words"]) for k, t in EDGES)
    assert Counter(k[:3] for k in got.elements()) == want
    assert not any(kept for key, n, _, kept in got if n < 10 or key == 6)


def test_verdict(spark):
    clean = " ".join(f"word{i}" for i in range(200))
    line = "this line of text stands here many times over"
    rows = [(0, clean), (1, "\n".join([line] * 3 + [clean])), (2, "\n".join([line] * 40)), (3, clean + " spam eggs" * 60)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (False, True), 1: (False, True), 2: (True, False), 3: (True, False)}


@pytest.mark.parametrize("n_words", [30, 60, 99, 102])
def test_top_grams_of_short_texts(spark, n_words):
    """One repeated pair or triple between changing words fails at every size; a pair that stands there twice does not."""
    pair = [w for i in range(n_words // 3) for w in ("cheap", "pills", f"w{i}")]
    triple = [w for i in range(n_words // 4) for w in ("buy", "cheap", "pills", f"w{i}")]
    clean = [f"word{i}" for i in range(n_words)]
    clean[3:5] = clean[-5:-3] = ["extraordinarily", "straightforward"]
    rows = [(i, " ".join(words)) for i, words in enumerate((pair, triple, clean))]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in repetition_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (False, False), 1: (False, False), 2: (False, True)}


def test_empty_table(nothing):
    assert repetition_rules(nothing).count() == 0

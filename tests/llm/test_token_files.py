import zlib

import numpy as np
import pytest

from crashrisk.llm import token_files
from crashrisk.llm.token_files import PerfectHash, document_summaries, fetch_documents, op5, vocabulary_file, write_token_files
from tests.llm.conftest import EDGES


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_file())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_documents(spark, sf_dir, document_rows, tokenizer):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op5(spark, sf_dir).collect()}
    start = 0
    for key, text in sorted(document_rows):
        ids = np.array(ids_of(tokenizer, text), dtype="<u4")
        assert got[key] == (start, len(ids), zlib.crc32(ids.tobytes())), key
        start += len(ids)
    assert len(got) == len(document_rows)


def test_edges(spark, edges, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 64)  # shards of a few documents
    path = str(tmp_path / "files")
    write_token_files(edges, path, vocabulary_file())
    rows = document_summaries(spark, path).collect()
    ordered = sorted(rows, key=lambda r: r["start"])
    keys = [r["doc_id"] for r in ordered]
    assert keys == sorted((k for k, _ in EDGES), key=lambda k: (k is not None, k or 0))
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1]]
    crc = lambda text: zlib.crc32(np.array(ids_of(tokenizer, text), "<u4").tobytes())
    assert sorted(str((r["doc_id"], r["ids_crc32"])) for r in rows) == sorted(str((k, crc(t))) for k, t in EDGES)
    fetched = sorted((r["doc_id"], r["ids"]) for r in fetch_documents(spark, path, [5, 1, 404, 2]).collect())
    assert fetched == sorted((k, ids_of(tokenizer, t)) for k, t in EDGES if k in (1, 2, 5))


def test_empty_table(spark, nothing, tmp_path):
    path = str(tmp_path / "files")
    write_token_files(nothing, path, vocabulary_file())
    assert document_summaries(spark, path).count() == 0 and fetch_documents(spark, path, []).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        index = PerfectHash.build(keys)
        assert sorted(index.find(keys)) == list(range(len(keys)))
        others = np.setdiff1d(rng.integers(-(2**62), 2**62, 20_000), keys)
        assert (index.find(others) >= 0).sum() <= 1


def test_words_in_pieces_get_the_ids_of_whole_texts(tokenizer):
    rng = np.random.default_rng(11)
    parts = ["a", "Z", "the", "İ", "ß", "Σ", "é", "é", "H̱", "̸", "'", "'s", "'LL", "don't", "<|endoftext|>", "<|", "|>",
             "<|ENDOFTEXT|>", "endoftext", ".", ",,", "…", "#", "&&", "0", "42", "½", " ", "​", "漢字", "🙂", "\x00", "\x1c", "_", "-"]
    gaps = ["", "", "", " ", "\n", "\t ", "\x0b"]
    texts = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.integers(1, 12))) for _ in range(4_000)]
    texts += [a + b for a in parts for b in parts] + ["", " ", "." * 5_000, "x" + "!" * 5_000]
    words = token_files.Words(vocabulary_file())
    for begin in range(0, len(texts), 500):
        part = texts[begin:begin + 500]
        ids, bounds = words.encode([t.encode() for t in part], 1)
        for i, text in enumerate(part):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == ids_of(tokenizer, text), repr(text)

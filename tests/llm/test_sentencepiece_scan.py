import random

import numpy as np
import pytest

from crashrisk.llm.sentencepiece_scan import MARK, NEVER, Vocabulary, _prefixes, combine, decode, encode, op3
from crashrisk.llm.token_files import vocabulary_file
from tests.llm.conftest import EDGES

PATH = vocabulary_file("piece_bpe_32k.model")
ODD = ["", "a", "  lead", " trail ", "\n\n x  y   z", "日本語 テキスト 漢字", "x" * 3000, "a b \U0001f600 end", "aaaaaaaaaaaaaaaaaaaaaaa bbbbbb", "ab" * 500]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


@pytest.fixture(scope="module")
def texts(document_rows):
    return [t for _, t in document_rows if len(t) < 20_000] + ODD


def test_same_ids_as_the_library(vocabulary, texts):
    """The library's own unigram model with these scores cuts every text the same way."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        if vocabulary.pieces.get(piece.piece, (None,))[0] == i:
            piece.score = vocabulary.pieces[piece.piece][1]
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    own = Vocabulary(PATH)
    own.unknown_score = min(s for _, s in own.pieces.values()) - 10  # the library's distance, whatever the unit
    ids, bounds = own.encode([t.encode() for t in texts])
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert library.encode(text) == ids[a:b].tolist(), text[:80]


def test_round_trip(vocabulary, texts):
    ids, bounds = vocabulary.encode([t.encode() for t in texts])
    assert vocabulary.decode(ids, bounds) == texts
    marked = "a " + MARK + "b"  # a space mark in a text is a space
    assert vocabulary.decode(*vocabulary.encode([marked.encode()])) == ["a  b"]


def test_best_score(vocabulary):
    """Against all ways to cut short texts."""
    rng = random.Random(4)

    def best(text):
        if not text:
            return 0
        options = [vocabulary.pieces[text[:j]][1] + best(text[j:]) for j in range(1, min(16, len(text)) + 1) if text[:j] in vocabulary.pieces]
        return max(options + [vocabulary.unknown_score + best(text[1:])] * (text[0] not in vocabulary.pieces))

    for _ in range(60):
        text = MARK + "".join(rng.choice("theanigrso日") for _ in range(rng.randrange(1, 10)))
        assert vocabulary.forward(text, len(text), [0])[0][-1] == best(text)


def test_combination_is_associative():
    rng = np.random.default_rng(3)
    a, b, c = np.where(rng.random((3, 5, 5)) < 0.3, NEVER, rng.integers(-100, 0, (3, 5, 5)))
    assert (np.maximum(NEVER // 2, combine(combine(a, b), c)) == np.maximum(NEVER // 2, combine(a, combine(b, c)))).all()
    stack = rng.integers(-50, 0, (7, 4, 4))
    whole = stack[0]
    for matrix, prefix in zip(stack[1:], _prefixes(stack)[1:]):
        whole = combine(whole, matrix)
        assert (whole == prefix).all()


@pytest.mark.parametrize("chunk", [16, 61, 500])
def test_chunks_change_nothing(spark, texts, chunk):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: r["ids"] for r in encode(frame, PATH).collect()}
    parts = {r["doc_id"]: r["ids"] for r in encode(frame, PATH, giant=chunk, chunk=chunk).collect()}
    assert whole == parts
    back = {r["doc_id"]: r["text"] for r in decode(encode(frame, PATH, giant=chunk, chunk=chunk), PATH).collect()}
    assert back == dict(enumerate(texts))


def test_edges(spark, edges, nothing, vocabulary):
    want = sorted(str((k, vocabulary.encode([(t or "").encode()])[0].tolist())) for k, t in EDGES)
    for giant in (1 << 16, 20):
        assert sorted(str((r["doc_id"], r["ids"])) for r in encode(edges, PATH, giant=giant, chunk=32 if giant == 20 else 4096).collect()) == want
    assert encode(nothing, PATH).count() == 0
    with pytest.raises(ValueError):
        encode(edges, PATH, chunk=3)


def test_query(spark, sf_dir, document_rows):
    import zlib

    got = {r["doc_id"]: r for r in op3(spark, sf_dir).collect()}
    assert {k: (len(t), zlib.crc32(t.encode())) for k, t in document_rows} == {k: (r["n_chars"], r["text_crc32"]) for k, r in got.items()}
    assert all(r["n_tokens"] == len(r["ids"]) for r in got.values())

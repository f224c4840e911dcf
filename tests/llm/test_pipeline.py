"""Stages against brute force, each on the rows its predecessor kept."""

import numpy as np
import pytest

import corpus_pipeline
from crashrisk.llm.decontamination import template_matches
from crashrisk.llm.sentencepiece_scan import Vocabulary
from crashrisk.llm.token_files import vocabulary_file
from crashrisk.llm.toxicity import learn_toxicity, score_toxicity
from tests.llm.test_jaccard_join import brute as brute_components


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """name -> (rows before, rows after, frame before)."""
    out, docs = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = ({r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in after.collect()}, docs)
        assert after.count() == len(out[name][1])
        if name != "sentencepiece":
            assert after.dtypes == docs.dtypes
        docs = after
    return out


def test_toxic_documents_go(spark, sf_dir, stages):
    before, after, docs = stages["toxicity"]
    model = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = {r["doc_id"] for r in score_toxicity(docs, model).collect() if r["score"] >= 0.5}
    assert set(after) == set(before) - toxic and all(after[k] == before[k] for k in after)


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["ngram_jaccard"]
    low = {key: smallest for key, _, smallest in brute_components([(k, r["text"]) for k, r in before.items()], 5, 80, 100)}
    assert set(after) == set(low.values()) and all(after[k] == before[k] for k in after)


def test_repeats_are_cut(stages):
    before, after, _ = stages["suffix_dedup"]
    seen, kept = {}, {}
    for key in sorted(before):
        data = before[key]["text"].encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - 49):
            if seen.setdefault(data[i:i + 50], key) < key:
                gone[i:i + 50] = True
        if gone.any():
            at, text = 0, ""
            for char in before[key]["text"]:  # a character that is cut in part stays
                size = len(char.encode())
                text += "" if gone[at:at + size].all() else char
                at += size
            kept[key] = text
        else:
            kept[key] = before[key]["text"]
    assert {k: r["text"] for k, r in after.items()} == {k: t for k, t in kept.items() if t == before[k]["text"] or t.strip(" ")}
    assert all(r["n_chars"] == len(r["text"]) for k, r in after.items() if r["text"] != before[k]["text"])


def test_contaminated_documents_go(spark, sf_dir, stages):
    before, after, docs = stages["decontamination"]
    hits = template_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").collect()
    assert set(after) == set(before) - {r["doc_id"] for r in hits}


def test_ids(stages):
    before, after, _ = stages["sentencepiece"]
    vocabulary = Vocabulary(vocabulary_file("piece_bpe_32k.model"))
    keys = sorted(before)
    ids, bounds = vocabulary.encode([before[k]["text"].encode() for k in keys])
    assert {k: r["ids"] for k, r in after.items()} == {k: ids[a:b].tolist() for k, a, b in zip(keys, bounds, bounds[1:])}


def test_edges(spark, sf_dir, tmp_path):
    """Nulls, empty and repeated rows, and an empty table, through every stage."""
    rows = [(1, "some words that stand here, enough of them for a shingle or two", "en", "s", 60), (2, None, None, None, None), (3, "", "en", "s", 0),
            (None, "text without a key, a little longer than the other ones", "en", None, 55), (1, "some words that stand here, enough of them for a shingle or two", "en", "s", 60)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{len(part)}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
        assert sorted(str(r["doc_id"]) for r in docs.collect()) == (["1", "2", "3", "None"] if part else [])

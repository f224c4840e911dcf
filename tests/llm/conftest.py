import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

#: Rows every operator on documents must take: nulls, empty and wordless texts, one long text, repeated rows.
EDGES = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, " \n\t "), (5, "word"),
         (None, "a text without a key that is long enough to be of some use to the operators here"), (6, "long words here " * 20_000),
         (1, "one two three four five six seven eight nine ten eleven twelve"), (7, "éè 日本語 \U0001f600 \x00 end"),
         (5, "another text with the same key")]


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows, with extra columns named like those operators make themselves."""
    names = ["key", "n", "cid", "row_key", "token", "value", "label", "score", "hash", "words", "ids", "bucket", "kept_text", "digest"]
    frame = spark.createDataFrame(EDGES, "doc_id long, text string")
    return frame.selectExpr("doc_id", "text", *(f"'x' AS {n}" for n in names))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

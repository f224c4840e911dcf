"""A corpus pipeline: each stage works on everything its predecessor kept, through Parquet in the shared folder.

Toxic documents go, one document of each group of near copies stays, byte strings that an
earlier document holds are cut out, documents with benchmark passages go, and what is left
is encoded. All stages but the last return the columns of ``documents``; n_chars follows
the text where a stage shortens it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashrisk.llm.components import stored
from crashrisk.llm.decontamination import contaminated_keys
from crashrisk.llm.jaccard_join import one_of_each
from crashrisk.llm.sentencepiece_scan import encode
from crashrisk.llm.suffix_dedup import remove_repeats
from crashrisk.llm.token_files import vocabulary_file
from crashrisk.llm.toxicity import drop_toxic_rows, learn_toxicity
from crashrisk.session import scratch_path

#: Words of an n-gram and similarity of near copies.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)
#: Contaminated rows up to which their keys are broadcast (8 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic_rows(docs, learn_toxicity(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest doc_id; texts without words all stay."""
    num, den = SIMILARITY
    return one_of_each(docs, words=SHINGLE_WORDS, num=num, den=den)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that an earlier one holds; one of which nothing is left goes."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    rest = remove_repeats(docs.withColumn("_none", F.col("text").isNull()), keep=(*others, "_none")).where("n_removed = 0 OR trim(kept_text) <> ''")
    size = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("kept_columns.n_chars")).cast("long")
    columns = {"doc_id": F.col("doc_id"), "text": F.when(~F.col("kept_columns._none"), F.col("kept_text")), "n_chars": size}
    return rest.select(*(columns.get(c, F.col("kept_columns").getField(c)).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, reworded numbers and names included."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    leaked = stored(contaminated_keys(named, benchmark, "_row"), "leaked")
    if leaked.count() <= BROADCAST_ROWS:
        leaked = F.broadcast(leaked)
    return named.join(leaked, "_row", "left_anti").drop("_row")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every document."""
    ids = encode(docs, vocabulary_file("piece_bpe_32k.model"))
    return ids.withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


#: (name, function of (spark, docs, sf_dir)) in the order they run.
STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: SQL cannot train a classifier or merge transforms; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Conversations without quotes, by linking quoted passages to the messages they come from.

Lines that begin with ">" are quotes, as deep as they have such signs. Every quoted
passage (a run of lines of one depth, its paragraphs and its lines) is normalised and
hashed, and joined to the messages whose own words it repeats. A message answers the one
that owns most of what it quotes at the first level; without a found quote it answers the
turn before its own. Quotes and the lines that introduce them are taken out, and the
answers give every message its thread, its depth and the order to read it in.

A passage that very many messages hold (a greeting, a signature) has one owner per
conversation and one in all, found by aggregates that are reduced before the shuffle; no
pairs of holders are made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashrisk.llm.components import stored
from crashrisk.llm.registry import query

_QUOTE = re.compile(r"^(?:[ \t]?>)+[ \t]?")
#: Lines that introduce a quote, in the languages of the tables.
_INTRODUCTION = re.compile(
    r"^\s*(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb\b.{0,100}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió|"
    r".{1,100}\b(?:wrote|schrieb|a écrit|escribió)|-+ ?original message ?-+)\s*:?\s*$", re.IGNORECASE)
_WORDS = re.compile(r"\w+")
#: Words a line or paragraph needs to be looked up by itself; a whole passage needs one.
LEAST_WORDS = 3


def _hash(lines: list[str]) -> tuple[int, int] | None:
    """(hash, number of words) of lines without case, punctuation and line breaks."""
    words = _WORDS.findall(" ".join(lines).casefold())
    return (xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "replace")) - (1 << 63), len(words)) if words else None


def _units(lines: list[str]) -> dict[int, int]:
    """Hashes of a passage, of its paragraphs and of its lines, with their numbers of words."""
    out, paragraph = {}, []
    for unit, least in [(lines, 1), *(([line], LEAST_WORDS) for line in lines)]:
        if (found := _hash(unit)) and found[1] >= least:
            out[found[0]] = found[1]
    for line in [*lines, ""]:
        if line.strip():
            paragraph.append(line)
        else:
            if (found := _hash(paragraph)) and found[1] >= LEAST_WORDS:
                out[found[0]] = found[1]
            paragraph = []
    return out


def parse_message(text: str) -> tuple[str, dict[int, int], list[tuple[int, dict[int, int]]]]:
    """(own text, own units, quoted passages as (depth, units)) of a message."""
    own, passages, depth, run = [], [], 0, []
    for line in text.split("\n"):
        sign = _QUOTE.match(line)
        level = sign[0].count(">") if sign else 0
        if level != depth and run:
            passages.append((depth, _units(run)))
            run = []
        if level and not depth:
            while own and not own[-1].strip():
                own.pop()
            if own and _INTRODUCTION.match(own[-1]):
                own.pop()
        depth = level
        if level:
            run.append(line[sign.end():])
        else:
            own.append(line)
    if run:
        passages.append((depth, _units(run)))
    own_text = "\n".join(own).strip() if passages else text
    return own_text, _units(own), passages


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    units = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int32())]))
    quotes = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int32()), ("passage", pa.int32()), ("depth", pa.int32())]))
    for batch in batches:
        out = []
        for text in batch.column(3).to_pylist():
            own, held, passages = parse_message(text or "")
            out.append((own, [{"hash": h, "words": w} for h, w in held.items()], len(passages),
                        [{"hash": h, "words": w, "passage": i, "depth": d} for i, (d, u) in enumerate(passages) for h, w in u.items()]))
        own, held, n, quoted = zip(*out) if out else ([], [], [], [])
        yield pa.record_batch([*batch.columns[:3], pa.array(own, pa.string()), pa.array(held, units), pa.array(n, pa.int64()),
                               pa.array(quoted, quotes)], names=["conv", "turn", "role", "own_text", "units", "n_quotes", "quotes"])


def unquote(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per row of ``df``, without its quotes and with its place among the answers.

    ``parent_conv`` and ``parent_turn`` name the message it answers (null if none),
    ``thread_conv`` and ``thread_turn`` the first message of its thread, ``depth`` the
    answers between; reading a thread by (depth, conversation, turn) puts every answer
    behind what it answers. ``n_quotes`` counts quoted passages, ``n_linked`` those found
    in another message.

    A passage belongs to the first turn of the conversation that holds it, if that is
    earlier, or else to the first message in all conversations by (conversation, turn); a message is
    never linked to itself nor to one that is not before it in that order. Null texts are
    empty. Rows without a conversation or turn keep their own text and are threads of
    their own; rows that share both are one message to others (ties go by nothing else).
    Other columns are not read.
    """
    rows = df.select(F.col(conversation).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
                     F.col(role).alias("role"), F.col(text).alias("text"))
    kind = rows.schema["role"].dataType.simpleString()
    parsed = stored(rows.mapInArrow(_parsed, f"conv long, turn long, role {kind}, own_text string, units array<struct<hash: long, words: int>>, "
                                    "n_quotes long, quotes array<struct<hash: long, words: int, passage: int, depth: int>>"), "messages")
    named = parsed.where("conv IS NOT NULL AND turn IS NOT NULL")
    quoted = named.select("conv", "turn", F.explode("quotes").alias("q")).select("conv", "turn", "q.*")

    # owners only of what is quoted anywhere
    wanted = quoted.select("hash").distinct()
    held = named.select("conv", "turn", F.explode("units.hash").alias("hash")).join(wanted, "hash", "left_semi")
    held = stored(held.groupBy("hash", "conv", "turn").agg(F.lit(1).alias("one")).drop("one"), "owners")
    anywhere = held.groupBy("hash").agg(F.min("conv").alias("owner_conv")).join(
        held.withColumnRenamed("conv", "owner_conv"), ["hash", "owner_conv"]).groupBy("hash", "owner_conv").agg(F.min("turn").alias("owner_turn"))
    here = held.groupBy("hash", "conv").agg(F.min("turn").alias("before"))
    linked = (quoted.join(here, ["hash", "conv"], "left").withColumn("before", F.expr("CASE WHEN before < turn THEN before END"))
              .join(anywhere, "hash", "left")
              .withColumn("p_conv", F.expr("CASE WHEN before IS NOT NULL THEN conv WHEN owner_conv < conv THEN owner_conv END"))
              .withColumn("p_turn", F.expr("CASE WHEN before IS NOT NULL THEN before WHEN owner_conv < conv THEN owner_turn END"))
              .where("p_conv IS NOT NULL"))
    votes = linked.where("depth = 1").groupBy("conv", "turn", "p_conv", "p_turn").agg(F.sum("words").alias("words"))
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct("words", "p_conv", "p_turn")).alias("best")).select(
        "conv", "turn", F.col("best.p_conv").alias("q_conv"), F.col("best.p_turn").alias("q_turn"))
    counts = linked.groupBy("conv", "turn").agg(F.countDistinct("passage").alias("n_linked"))
    messages = named.select("conv", "turn").distinct()
    before = messages.select("conv", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("last"))
    links = messages.join(before, ["conv", "turn"], "left").join(best, ["conv", "turn"], "left").join(counts, ["conv", "turn"], "left").select(
        "conv", "turn", F.coalesce("q_conv", F.expr("CASE WHEN last IS NOT NULL THEN conv END")).alias("parent_conv"),
        F.when(F.col("q_conv").isNotNull(), F.col("q_turn")).otherwise(F.col("last")).alias("parent_turn"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
    links = _threads(stored(links, "answers"))
    joined = parsed.join(links, ["conv", "turn"], "left")
    return joined.select(
        F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role), F.col("own_text").alias(text),
        "parent_conv", "parent_turn", F.coalesce("thread_conv", "conv").alias("thread_conv"), F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))


def _threads(links: DataFrame) -> DataFrame:
    """Adds the thread's first message and the depth, by doubling steps up the answers.

    A message answers an earlier one, so there are no circles, and a thread of n messages
    takes log n rounds.
    """
    state = links.select("conv", "turn", F.coalesce("parent_conv", "conv").alias("thread_conv"),
                         F.coalesce("parent_turn", "turn").alias("thread_turn"),
                         F.when(F.col("parent_conv").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("depth"),
                         F.col("parent_conv").isNotNull().alias("open"))
    while not (climbing := state.where("open")).isEmpty():
        up = state.select(F.col("conv").alias("thread_conv"), F.col("turn").alias("thread_turn"), F.col("thread_conv").alias("u_conv"),
                          F.col("thread_turn").alias("u_turn"), F.col("depth").alias("u_depth"), F.col("open").alias("u_open"))
        # messages that have found their thread's first one climb no more
        climbed = climbing.join(up, ["thread_conv", "thread_turn"]).select(
            "conv", "turn", F.col("u_conv").alias("thread_conv"), F.col("u_turn").alias("thread_turn"),
            (F.col("depth") + F.col("u_depth")).alias("depth"), F.col("u_open").alias("open"))
        state = stored(state.where("NOT open").unionByName(climbed), "threads")
    return links.join(state.drop("open"), ["conv", "turn"])


@query("op4_quotation_links")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unquote(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

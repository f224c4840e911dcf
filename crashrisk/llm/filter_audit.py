"""How filters interact: what each removes at each place of every order, from decision diagrams.

The documents of a part are counted by failure mask (which filters they fail), and the
counts become a decision diagram: one level for each filter, two edges (passes, fails)
out of each node, equal nodes of a level shared, counts at the end. Swapping two
neighbouring levels rewrites these levels only, and a walk of neighbouring swaps visits
every order of the filters. In each order the path on which all filters pass gives the
steps: the weight that leaves it at a level is what that filter removes there.

Only the masks need the texts. Copies are found by 128-bit digests and never meet in one
task: a copy group is reduced to its smallest key by an aggregate, and joined back by
digest and key. At most 2**filters counts per part go to the diagrams.

Defined cases: a null text is empty. A null part is the empty part. A row without a key
is in no copy group and has no labels. Rows of equal key and text are not copies of each
other. A key with several label rows counts as good (toxic) if one of them says so. An
empty table gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashrisk.llm import textarrays as ta
from crashrisk.llm.registry import query

#: Limits of the first three filters: words, distinct words in 100, capitals in 100.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
#: Filters of an audit at most, as all orders of them are reported.
MOST_FILTERS = 7

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#$%&*|")] = True
_COUNTED = ("n", "good", "toxic")
_FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


class Diagram:
    """A decision diagram over failure bits, with counts at its ends; equal nodes of a level are one.

    ``levels[i]`` lists the nodes of level i as (pass, fail), numbers of nodes of the next
    level, or of ``ends`` behind the last. ``order[i]`` is the filter of level i.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: int, width: int):
        self.order = list(range(filters))
        self.ends: list[tuple[int, ...]] = []
        end_of: dict[tuple[int, ...], int] = {}
        nothing = (0,) * width
        # with filter 0 at the top, its bit is the highest of a leaf's place
        below = []
        for place in range(1 << filters):
            mask = sum(1 << f for f in range(filters) if place >> (filters - 1 - f) & 1)
            value = tuple(counts.get(mask, nothing))
            below.append(end_of.setdefault(value, len(end_of)))
        self.ends = list(end_of)
        self.levels: list[list[tuple[int, int]]] = []
        for _ in range(filters):
            known: dict[tuple[int, int], int] = {}
            below = [known.setdefault(pair, len(known)) for pair in zip(below[::2], below[1::2])]
            self.levels.insert(0, list(known))
        self._weigh(range(filters))

    def _weigh(self, levels: range) -> None:
        """Sums of the counts below each node, for these levels from the bottom up."""
        if not hasattr(self, "weights"):
            self.weights: list[np.ndarray] = [np.zeros(0)] * len(self.levels) + [np.array(self.ends, dtype=np.int64)]
        for level in reversed(levels):
            children = np.array(self.levels[level], dtype=np.int64)
            self.weights[level] = self.weights[level + 1][children[:, 0]] + self.weights[level + 1][children[:, 1]]

    def swap(self, level: int) -> None:
        """Exchange the filters of this level and the next; levels above and below stay as they are."""
        upper, lower = self.levels[level], self.levels[level + 1]
        known: dict[tuple[int, int], int] = {}
        turned = []
        for passes, fails in upper:
            (pp, pf), (fp, ff) = lower[passes], lower[fails]
            turned.append((known.setdefault((pp, fp), len(known)), known.setdefault((pf, ff), len(known))))
        self.levels[level], self.levels[level + 1] = turned, list(known)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        self._weigh(range(level, level + 2))

    def steps(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(filter, weight kept, weight removed) along the path on which every filter passes."""
        out, node = [], 0
        for level, filter_ in enumerate(self.order):
            passes, fails = self.levels[level][node]
            out.append((filter_, self.weights[level + 1][passes], self.weights[level + 1][fails]))
            node = passes
        return out


def neighbour_swaps(n: int) -> Iterator[int]:
    """Levels to swap with the next, one after the other, so that every order of n filters is met once."""
    if n < 2:
        return
    shorter = [*neighbour_swaps(n - 1), None]
    for turn, swap in enumerate(shorter):
        # the last filter walks through the others, up and down in turn
        yield from reversed(range(n - 1)) if turn % 2 == 0 else range(n - 1)
        if swap is not None:
            yield swap + (turn % 2 == 0)  # it stands before them after a walk up, behind them after one down


def audit_counts(counts: dict[int, tuple[int, ...]], names: str) -> Iterator[tuple]:
    """Rows (order, step, *figures) of one part, from (documents, good, toxic) by failure mask."""
    n = len(names)
    diagram = Diagram(counts, n, len(_COUNTED))
    fails = [sum(v[0] for m, v in counts.items() if m >> f & 1) for f in range(n)]
    unique = [0] * n
    shapley, rows = [0] * n, []
    for swap in itertools.chain([None], neighbour_swaps(n)):
        if swap is not None:
            diagram.swap(swap)
        path = diagram.steps()
        order = "".join(names[f] for f, _, _ in path)
        for step, (f, kept, removed) in enumerate(path, 1):
            shapley[f] += int(removed[0])
            rows.append((order, step, f, [int(kept[0]), int(removed[0]), fails[f] - int(removed[0])], [int(removed[1]), int(removed[2])]))
        last = path[-1]
        unique[last[0]] = int(last[2][0])  # what the last filter removes, all others have passed
    for order, step, f, first, lost in rows:
        yield (order, step, *first, unique[f], *lost, shapley[f])


def _audited(batches: Iterator[pa.RecordBatch], names: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, counted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = list(audit_counts({c["mask"]: tuple(c[x] for x in _COUNTED) for c in counted}, names))
            columns = list(zip(*rows))
            yield pa.record_batch(
                [pa.array([part] * len(rows)), pa.array(columns[0]), pa.array(columns[1], pa.int32())]
                + [pa.array(c, pa.int64()) for c in columns[2:]], names=["part", "filter_order", "step", *_FIGURES])


def interaction_audit(masks: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters ``names`` (a letter each) and step, with the documents kept, removed and so on.

    ``masks``: part, mask (bit i: fails filter i), n, good and toxic (documents, and those
    of them labelled so); rows of equal part and mask are added up.
    """
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders; {MOST_FILTERS} at most")
    counted = masks.groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in _COUNTED))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *_COUNTED)).alias("counted"))  # 2**filters rows at most
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _FIGURES)
    return parts.mapInArrow(partial(_audited, names=names), schema)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, texts in ta.slices(batch.column(2)):
            n_texts = len(texts)
            data, starts = ta.joined(texts)
            begin, end = ta.word_bounds(data)
            bounds = ta.owner_bounds(begin, starts)
            n_words = np.diff(bounds)
            owner = np.repeat(np.arange(n_texts), n_words)
            salt = ta.mix(np.arange(1, n_texts + 1, dtype=np.uint64))
            _, seen = np.unique(ta.range_hashes(ta.prefix_sums(data), begin, end) ^ salt[owner], return_index=True)
            distinct = np.bincount(owner[seen], minlength=n_texts)

            def total(flags: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(flags)])
                return sums[starts[1:] - 1] - sums[starts[:-1]]  # without the line feed put after each text

            capitals, points = total((data >= 65) & (data <= 90)), total((data & 0xC0) != 0x80)
            mask = ((n_words < LEAST_WORDS) + 2 * (100 * distinct < LEAST_DISTINCT * n_words)
                    + 4 * (100 * capitals > MOST_CAPITALS * points) + 8 * (total(_SYMBOLS[data]) > 0))
            digests = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), dtype="<i8").reshape(-1, 2)
            rows = batch.slice(first, last - first)
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(mask.astype(np.int32)), *(pa.array(np.ascontiguousarray(digests[:, i])) for i in (0, 1))],
                                  names=["key", "part", "mask", "d0", "d1"])


def document_masks(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Failure masks of the five filters A to E by part, as ``interaction_audit`` takes them.

    A: under 200 words; B: under 50 distinct words in 100; C: over 2 capitals in 100 code
    points; D: one of ``#$%&*|``; E: the same text as a row with a smaller key. ``labels``:
    the key, quality and toxic.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    measured = rows.mapInArrow(_measured, f"key {kind}, part string, mask int, d0 long, d1 long")
    # equal rows become one with a count before anything is joined
    met = measured.groupBy("key", "part", "mask", "d0", "d1").agg(F.count(F.lit(1)).alias("n"))
    keyed = met.where("key IS NOT NULL")
    first = keyed.groupBy("d0", "d1").agg(F.min("key").alias("key")).withColumn("is_first", F.lit(True))
    marked = keyed.join(first, ["d0", "d1", "key"], "left")
    known = labels.select(F.col(key).alias("key"), "quality", "toxic").where("key IS NOT NULL").groupBy("key").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    judged = marked.join(known, "key", "left").select(
        "part", (F.col("mask") + F.when(F.col("is_first"), 0).otherwise(16)).alias("mask"), "n",
        *((F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")))
    unkeyed = met.where("key IS NULL").select("part", "mask", "n", *(F.lit(0).cast("long").alias(c) for c in ("good", "toxic")))
    return judged.unionByName(unkeyed)


_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS lowest FROM d),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INTEGER + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INTEGER
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INTEGER
    + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * coalesce(w.doc_id > lowest, false)::INTEGER AS mask
  FROM w LEFT JOIN l USING (doc_id)),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, ascii(substr(filter_order, step, 1)) - 65 AS i,
    (SELECT coalesce(sum(1 << (ascii(x) - 65)), 0) FROM (SELECT unnest(string_split(substr(filter_order, 1, step - 1), '')) AS x) WHERE x <> '') AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)),
r AS (SELECT part, filter_order, step, i,
    sum(CASE WHEN mask & (before | (1 << i)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & (1 << i) <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & (1 << i) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = (1 << i) THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & (1 << i) <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & (1 << i) <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, i)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM r
"""


@query("op12_filter_audit", _SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = document_masks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return interaction_audit(masks, "ABCDE")

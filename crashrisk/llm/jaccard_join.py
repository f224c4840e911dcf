"""Exact Jaccard join of word n-gram sets over a partitioned universe.

Two sets of sizes n <= l with Jaccard t or more differ in at most
H = (n + l)(1 - t) / (1 + t) elements. Hash the universe of n-grams into m segments,
m set by the size band: two such sets agree on every segment but at most H, so each set
need only show H + 1 of its segments in an order both follow, and a similar pair shares
one. In the bands of small sets a segment may also show its one-deletion neighbourhood,
which costs a pair two differences to miss and so counts twice. The order is chosen by
cost: per band, segments (and neighbourhoods) whose shown values coincide least come
first, as measured over all sets.

What keeps this whole and bounded under skew:

* N-grams found in a great share of all texts (``HOT_SHARE``) are left out of segments.
  Differences only get fewer by that, so the bound holds. Sets left with too few segments
  are also shown in a second scheme with all n-grams, and those with too few even there
  by the n-grams of their prefix.
* An empty segment is never shown: it does not count towards the H + 1.
* Equal sets are one class. Members of a bucket are compared with a pivot first, and
  linked classes get one label; only pairs whose labels still differ are then compared
  with each other. Comparisons left out join nothing new: both ends are in one component.
* Pairs are held against their sizes and parity sketches before a set is fetched; the bits in
  which two sketches differ are a lower bound of the elements in which the sets do. Sketches of
  one length tell large sets apart no more, so pairs that pass are held against sketches as
  long as the sets (in bits), and only sets of pairs that pass these too are made.
* Shown values travel packed by bucket; values that many classes of one task share skip
  the bucket and go out as rows.

N-grams are 64-bit hashes and classes 64-bit sums of them: two different classes out of a
billion meet by chance with a likelihood of 3 %.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashrisk.llm import textarrays as ta
from crashrisk.llm.components import components, discard, stored
from crashrisk.llm.registry import query

#: N-grams in more than this share of the texts (and in HOT_LEAST texts) are left out of segments; HOT_MOST bounds their list.
HOT_SHARE, HOT_LEAST, HOT_MOST = 0.001, 32, 65_536
#: Bands with at most so many segments may show one-deletion neighbourhoods.
DELETION_SEGMENTS = 8
#: Values shown by a bucket's task at once, and classes of one task from which a value goes out as rows.
BUCKET_VALUES, DIRECT_CLASSES = 1_000_000, 64
#: Shown values that are put in their order of cost at once.
RUN_VALUES = 250_000
#: Rounds of comparison with pivots before the remaining pairs of different labels are compared.
PIVOT_ROUNDS = 2
#: 64-bit words of a set's parity sketch.
SKETCH = 8
#: Classes up to which the names of those whose sets are wanted are broadcast (16 bytes each); beyond, texts are shuffled.
BROADCAST_CLASSES = 1_000_000


class Scheme:
    """Size bands, segments and bounds for a threshold of num / den."""

    def __init__(self, num: int, den: int):
        if not 0 < num < den:
            raise ValueError("the threshold must lie between 0 and 1")
        self.num, self.den = num, den
        ratio, edges = max(1.5, den / num), [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * ratio)))
        self.edges = np.array(edges, dtype=np.int64)
        most = self.differences(self.edges[1:] - 1) + 1
        self.segments = np.append(most + np.maximum(1, -(-most // 4)), 1)

    def largest(self, n: np.ndarray) -> np.ndarray:
        """The largest set that can be similar to one of n elements."""
        return n * self.den // self.num

    def differences(self, n: np.ndarray) -> np.ndarray:
        """The most elements in which a set of n and a similar one can differ."""
        return (n + self.largest(n)) * (self.den - self.num) // (self.den + self.num)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, side="right") - 1


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of all texts in turn, where each text's begin; one more at the end).

    Words are split by white space after lower-casing A-Z. A text of fewer words has
    their whole sequence as its one n-gram; a text without words has none.
    """
    data, starts = ta.joined(texts)
    data = ta.lower_ascii(data)
    first, end = ta.word_bounds(data)
    hashes = ta.range_hashes(ta.prefix_sums(data), first, end)
    bounds = ta.owner_bounds(first, starts)
    sets = []
    for i in range(len(texts)):
        own = hashes[bounds[i]:bounds[i + 1]]
        sets.append(np.unique(ta.window_hashes(own, min(words, len(own)))) if len(own) else own)
    sizes = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=sizes[1:])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), sizes


def _class_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[np.uint64(0)], np.cumsum(ta.mix(tokens ^ np.uint64(0x51ED270B)))])
    return ta.mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ np.diff(bounds).astype(np.uint64)).view(np.int64)


def _segments(tokens: np.ndarray, owner: np.ndarray, band: np.ndarray, scheme: Scheme, deletions: bool, salt: int):
    """(owner, code, value) of all non-empty segments; code is twice the segment, plus one for a one-deletion neighbour.

    Only segments of two or more elements have neighbours, so that no shown value stands for an empty segment.
    """
    m = scheme.segments[band[owner]]
    segment = (ta.mix(tokens ^ np.uint64(salt)) % m.astype(np.uint64)).astype(np.int64)
    order = np.lexsort((segment, owner))
    tokens, owner, segment = tokens[order], owner[order], segment[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])
    at = np.flatnonzero(new)
    weights = ta.mix(tokens + np.uint64(0x2545F491))
    sums = np.add.reduceat(weights, at) if len(at) else weights
    places = ta.mix((band[owner[at]] << 32 | segment[at]).astype(np.uint64) ^ np.uint64(salt * 7 + 3))
    out = [(owner[at], 2 * segment[at], ta.mix(sums ^ places))]
    if deletions:
        of = np.cumsum(new) - 1
        sizes = np.diff(np.append(at, len(tokens)))
        keep = (sizes[of] >= 2) & (m[order] <= DELETION_SEGMENTS)
        out.append((owner[keep], 2 * segment[keep] + 1, ta.mix((sums[of] - weights)[keep] ^ places[of[keep]])))
    return tuple(np.concatenate(x) for x in zip(*out))


def _shown(tokens: np.ndarray, bounds: np.ndarray, scheme: Scheme, hot: np.ndarray, visiting: bool):
    """(owner, code, value) under each set's own band, or under the next band for sets with larger partners there.

    Code -1 marks values that are always shown: those of sets with too few segments.
    """
    n = np.diff(bounds)
    band = scheme.band(np.maximum(n, 1)) + visiting
    need = scheme.differences(n) + 1
    wanted = need > 1
    if visiting:
        wanted &= scheme.largest(n) >= scheme.edges[band]
    owner = np.repeat(np.arange(len(n)), n)
    used = wanted[owner]
    tokens, owner = tokens[used], owner[used]
    at = np.minimum(np.searchsorted(hot, tokens), max(0, len(hot) - 1))
    cold = hot[at] != tokens if len(hot) else np.ones(len(tokens), dtype=bool)
    out = [_segments(tokens[cold], owner[cold], band, scheme, True, 11)]
    units = np.bincount(np.unique(np.stack([out[0][0], out[0][1]]), axis=1)[0], minlength=len(n))
    few = wanted & (units < need)
    if few.any():
        part = few[owner]
        whole = _segments(tokens[part], owner[part], band, scheme, False, 23)
        out.append((whole[0], np.full(len(whole[0]), -1), whole[2]))
        fewer = few & (np.bincount(whole[0], minlength=len(n)) < need)
        rank = np.arange(len(tokens)) - np.searchsorted(owner, owner)
        prefix = n - -(-n * scheme.num // scheme.den) + 1
        part = fewer[owner] & (rank < prefix[owner])
        places = ta.mix((band[owner[part]]).astype(np.uint64) + np.uint64(0xABCD))
        out.append((owner[part], np.full(part.sum(), -1), ta.mix(tokens[part] ^ places)))
    owner, code, value = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(owner, kind="stable")
    return owner[order], code[order], value[order], band, need


def _lists(owner: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _frequent(batches: Iterator[pa.RecordBatch], words: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """N-grams frequent within the task, with their counts (lossy counting: at most ``most`` are held)."""
    tokens, counts, texts_seen, dropped = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
    for batch in batches:
        for _, _, texts in ta.slices(batch.column(0)):
            found, _ = shingle_sets(texts, words)
            tokens, of = np.unique(np.concatenate([tokens, found]), return_inverse=True)
            counts = np.bincount(of, weights=np.concatenate([counts, np.ones(len(found))])).astype(np.int64)
            texts_seen += len(texts)
            while len(tokens) > most:
                dropped += 1
                keep = counts > dropped
                tokens, counts = tokens[keep], counts[keep]
    keep = counts >= max(3, HOT_SHARE * texts_seen / 2)
    yield pa.record_batch([pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep])], names=["token", "count"])


def _profiles(batches: Iterator[pa.RecordBatch], words: int, scheme: Scheme, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, texts in ta.slices(batch.column(2)):
            tokens, bounds = shingle_sets(texts, words)
            n = np.diff(bounds)
            columns = [batch.column(i).slice(first, last - first) for i in (0, 1)]
            columns += [pa.array(n), pa.array(_class_ids(tokens, bounds))]
            for visiting in (False, True):
                owner, code, value, band, need = _shown(tokens, bounds, scheme, hot, visiting)
                columns += [pa.array(band, pa.int32()), _lists(owner, code, len(n), pa.int32()),
                            _lists(owner, value.view(np.int64), len(n), pa.int64())]
            columns.append(pa.array(need))
            yield pa.record_batch(columns, names=["row_key", "key", "n", "cid", "band0", "codes0", "values0", "band1",
                                                  "codes1", "values1", "need"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of profiles in runs of about RUN_VALUES shown values; a set that shows more is a run of its own."""
    for batch in batches:
        sizes = sum(batch.column(f"codes{k}").value_lengths().to_numpy(zero_copy_only=False) for k in "01")
        first, ends = 0, np.cumsum(sizes)
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + RUN_VALUES, side="right")))
            yield batch.slice(first, last - first)
            first = last


def _packed(batches: Iterator[pa.RecordBatch], ranks: dict[int, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """The shown values each set needs, packed by bucket; the lowest bit of a value says that it is no neighbour."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        value, cid = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((cid, value))
        value, cid = value[order], cid[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (cid[1:] != cid[:-1])
        value, cid = value[new], cid[new]
        group = np.cumsum(np.concatenate([[True], value[1:] >> np.uint64(1) != value[:-1] >> np.uint64(1)])) - 1
        last = np.searchsorted(group, group, side="right") - 1
        direct = np.bincount(group)[group] > DIRECT_CLASSES
        bucket = ((value >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        # a value that goes out as rows leaves its last member in the bucket, which is no neighbour if it has one
        # that is none, so that others meet it there
        in_bucket = ~direct | (np.arange(len(value)) == last)
        for at, sign in ((np.flatnonzero(in_bucket), 1), (np.flatnonzero(direct), -1)):
            at = at[np.argsort(bucket[at], kind="stable")]
            kinds, starts = np.unique(bucket[at], return_index=True)
            parts = np.split(at, starts[1:]) if len(at) else []
            if parts:
                yield pa.record_batch(
                    [pa.array(sign * (kinds + 1)), pa.array([value[p].tobytes() for p in parts], pa.binary()),
                     pa.array([cid[p].tobytes() for p in parts], pa.binary())], names=["bucket", "values", "cids"])
        held.clear()

    for batch in _runs(batches):
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        cid, need = (columns[c].to_numpy(zero_copy_only=False) for c in ("cid", "need"))
        for k in "01":
            band = columns[f"band{k}"].to_numpy(zero_copy_only=False)
            sizes = columns[f"codes{k}"].value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(cid)), sizes)
            code = columns[f"codes{k}"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            value = columns[f"values{k}"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            rank = np.zeros(len(code), dtype=np.int64)
            for b in np.unique(band[owner]):
                at = np.flatnonzero((band[owner] == b) & (code >= 0))
                rank[at] = ranks[int(b)][code[at]]
            order = np.lexsort((rank, owner))
            owner, code, value, rank = owner[order], code[order], value[order], rank[order]
            counted = np.ones(len(code), dtype=bool)
            counted[1:] = (owner[1:] != owner[:-1]) | (rank[1:] != rank[:-1])
            counted &= code >= 0
            units = np.cumsum(counted)
            base = np.concatenate([[0], units])[np.searchsorted(owner, owner)]
            keep = (code < 0) | (units - base <= need[owner])
            exact = ((code < 0) | (code % 2 == 0)).astype(np.uint64)
            held.append(((value & ~np.uint64(1) | exact)[keep], cid[owner[keep]]))
        if sum(len(v) for v, _ in held) >= 500_000:
            yield from flush()
            ta.give_back()
    if sum(len(v) for v, _ in held):
        yield from flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, cid, exact) of all values with two or more classes, one of them not as a neighbour."""
    held, names = defaultdict(list), ["value", "cid", "exact"]

    def rows(value: np.ndarray, cid: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array((value >> np.uint64(1)).view(np.int64)), pa.array(cid),
                                pa.array((value & np.uint64(1)).astype(bool))], names=names)

    for batch in batches:
        for bucket, value, cid in zip(*(batch.column(i).to_pylist() for i in range(3))):
            value, cid = np.frombuffer(value, np.uint64), np.frombuffer(cid, np.int64)
            if bucket < 0:
                yield rows(value, cid)
            else:
                held[bucket].append((value, cid))
    # hashing puts several buckets into one task; each is sorted by itself
    while held:
        value, cid = (np.concatenate(x) for x in zip(*held.popitem()[1]))
        order = np.lexsort((cid, value))
        value, cid = value[order], cid[order]
        starts = np.flatnonzero(np.concatenate([[True], value[1:] >> np.uint64(1) != value[:-1] >> np.uint64(1)]))
        sizes = np.diff(np.append(starts, len(value)))
        several = np.minimum.reduceat(cid, starts) < np.maximum.reduceat(cid, starts)
        exact = np.maximum.reduceat(value & np.uint64(1), starts) > 0
        keep = np.repeat(several & exact, sizes)
        yield rows(value[keep], cid[keep])
    ta.give_back()


def _parities(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per set SKETCH 64-bit words: is the number of its elements that fall on each bit odd?

    Two sketches differ in no more bits than their sets in elements, whatever falls together.
    """
    n, width = len(bounds) - 1, 64 * SKETCH
    bit = np.repeat(np.arange(n), np.diff(bounds)) * width + (ta.mix(tokens ^ np.uint64(0x7F4A7C15)) % np.uint64(width)).astype(np.int64)
    odd = np.bincount(bit, minlength=n * width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64).reshape(n, SKETCH)


def _long_sketches(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Per set a parity sketch of a bit or more for each element; none where the short one has as many.

    Their lengths are powers of two, so that the longer of two folds to the length of the other.
    """
    out, mixed = [], ta.mix(tokens ^ np.uint64(0x3C6EF372))
    for a, b in zip(bounds, bounds[1:]):
        width = 1 << int(b - a - 1).bit_length() if b - a > 64 * SKETCH else 0
        odd = np.bincount((mixed[a:b] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1 if width else np.zeros(0)
        out.append(np.packbits(odd.astype(bool), bitorder="little").tobytes())
    return out


def _sketches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, texts in ta.slices(batch.column(2)):
            tokens, bounds = shingle_sets(texts, words)
            short = _parities(tokens, bounds)
            yield pa.record_batch(
                [batch.column(i).slice(first, last - first) for i in (0, 1)] + [pa.array(np.diff(bounds))]
                + [pa.array(np.ascontiguousarray(short[:, i])) for i in range(SKETCH)]
                + [pa.array(_long_sketches(tokens, bounds), pa.binary())],
                names=["row_key", "cid", "n", *(f"s{i}" for i in range(SKETCH)), "long"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, texts in ta.slices(batch.column(2)):
            tokens, bounds = shingle_sets(texts, words)
            yield pa.record_batch(
                [batch.column(1).slice(first, last - first), pa.array([tokens[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())],
                names=["cid", "grams"])


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[:len(sketch) // 2] ^ sketch[len(sketch) // 2:]
    return sketch


def _possible(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose long sketches, where both have one, leave a similarity of num / den possible."""
    for batch in batches:
        total = batch.column(2).to_numpy(zero_copy_only=False)
        keep = np.ones(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(side)[i].as_buffer(), np.uint64) for side in (3, 4))
            if len(a) and len(b):
                size = min(len(a), len(b))
                apart = int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())
                keep[i] = apart * (den + num) <= total[i] * (den - num)
        yield batch.select([0, 1]).filter(pa.array(keep))


def _verified(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(side)[i].as_buffer(), np.uint64) for side in (2, 3))
            shared = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
            linked.append(den * shared >= num * (len(a) + len(b) - shared))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _segment_ranks(profiles: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """Per band the place of each code in the order of cost, and the number of shown values.

    A code's cost is the number of its values that are not the first of their kind; a
    neighbourhood also costs its rows and comes after its segment. The table holds two
    rows for each segment of a band, so it grows with the longest text, not the corpus.
    """
    shown = profiles.selectExpr("inline(array(struct(band0 AS band, codes0 AS codes, values0 AS shown), "
                                "struct(band1 AS band, codes1 AS codes, values1 AS shown)))")
    shown = shown.selectExpr("band", "inline(arrays_zip(codes, shown))")
    costs = shown.groupBy("band", "codes").agg(F.count("*").alias("rows"), F.approx_count_distinct("shown").alias("kinds")).toArrow()
    bands, codes, rows, kinds = (costs[c].to_numpy() for c in ("band", "codes", "rows", "kinds"))
    ranks, total = {}, int(rows.sum())
    for band in np.unique(bands[codes >= 0]):
        part = (bands == band) & (codes >= 0)
        code, extra = codes[part], np.maximum(0, rows[part] - kinds[part]).astype(np.float64)
        cost = np.full(code.max() // 2 * 2 + 2, np.inf)
        cost[code] = extra
        neighbour = code[code % 2 == 1]
        cost[neighbour] += cost[neighbour - 1] + rows[part][code % 2 == 1]
        place = np.empty(len(cost), dtype=np.int64)
        place[np.lexsort((np.arange(len(cost)), cost))] = np.arange(len(cost))
        ranks[int(band)] = place
    return ranks, total


def similar_classes(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``df``: its key, n_shingles, component_id, class_id (equal for equal sets), and more.

    Two rows link when their sets of ``words``-word n-grams have a Jaccard similarity of
    num / den or more; component_id is the smallest key reachable by links, itself
    included. A row without words (or with a null text) links with nothing and is its own
    component. Equal rows are one class; rows with a null key take part, and get a null
    component_id only where no row of the component has a key; component_class names their
    component all the same. row_key is the hash of key and text. Other columns are not read.
    """
    spark, scheme = df.sparkSession, Scheme(num, den)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.select(F.xxhash64("key", "text").alias("row_key"), "key", "text")

    frequent = rows.select("text").mapInArrow(partial(_frequent, words=words), "token long, count long")
    least = max(HOT_LEAST, int(HOT_SHARE * rows.count()))
    hot = (frequent.groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
           .orderBy(F.desc("count"), "token").limit(HOT_MOST).toArrow()["token"].to_numpy().astype(np.int64))
    hot = np.sort(hot.view(np.uint64))

    schema = f"row_key long, key {kind}, n long, cid long, " + ", ".join(
        f"band{k} int, codes{k} array<int>, values{k} array<long>" for k in (0, 1)) + ", need long"
    profiles = stored(rows.mapInArrow(partial(_profiles, words=words, scheme=scheme, hot=hot), schema), "profiles")

    ranks, total = _segment_ranks(profiles)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_VALUES)
    packed = profiles.select("cid", "need", *(f"{c}{k}" for k in (0, 1) for c in ("band", "codes", "values"))).mapInArrow(
        partial(_packed, ranks=ranks, buckets=buckets), "bucket long, values binary, cids binary")
    members = stored(packed.repartition(buckets, "bucket").mapInArrow(_members, "value long, cid long, exact boolean")
                     .groupBy("value", "cid").agg(F.max("exact").alias("exact")), "members")
    # the shown values are the largest table of all and are not needed any more
    wide, profiles = profiles, stored(profiles.select("row_key", "key", "n", "cid"), "classes")
    discard(wide)

    # one row stands for each class that has company; its set is taken from its text again
    chosen = (profiles.where("n > 0").join(members.select("cid").distinct(), "cid", "left_semi")
              .groupBy("cid").agg(F.min("row_key").alias("row_key")))

    def picked(classes: DataFrame) -> DataFrame:
        # equal rows stand in one partition after the join, so their texts are not moved again
        return rows.join(classes, "row_key").select("row_key", "cid", "text").dropDuplicates(["row_key"])

    sketch = ", ".join(f"s{i} long" for i in range(SKETCH))
    sketches = stored(picked(chosen).mapInArrow(partial(_sketches, words=words), f"row_key long, cid long, n long, {sketch}, long binary"), "sketches")

    def sets(cids: DataFrame) -> DataFrame:
        """The sets of some classes, made for them alone."""
        wanted = stored(sketches.select("row_key", "cid").join(cids, "cid", "left_semi"), "wanted")
        few = wanted.count() <= BROADCAST_CLASSES  # then no text is shuffled but those that are wanted
        made = stored(picked(F.broadcast(wanted) if few else wanted).mapInArrow(partial(_sets, words=words), "cid long, grams binary"), "sets")
        discard(wanted)
        return made

    labels = _labels(members, sketches, sets, num, den)
    classes = profiles.where("n > 0").groupBy("cid").agg(F.min("key").alias("key"))
    classes = classes.join(labels, F.col("cid") == F.col("node"), "left").select(
        "cid", "key", F.coalesce("label", "cid").alias("label"))
    lowest = classes.groupBy("label").agg(F.min("key").alias("component_id"))
    classes = classes.join(lowest, "label").select("cid", "label", "component_id")
    return (profiles.select("row_key", "key", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(classes, "cid", "left")
            .select(F.col("key").alias(key), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
                    F.col("cid").alias("class_id"), F.col("label").alias("component_class"), "row_key"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay when of every component only the row with the smallest key does.

    Rows with a null key come after all others, ties go by the text's hash. Rows without
    words all stay; equal rows (same key, same text) are one row. All columns are kept.
    """
    groups = similar_classes(df, key, text, **options)
    first = (groups.where("n_shingles > 0").groupBy("component_class")
             .agg(F.min(F.struct(F.col(key).isNull().alias("late"), F.col(key).alias("key"), "row_key")).alias("first")))
    chosen = first.select(F.col("first.row_key").alias("_row_key")).unionByName(
        groups.where("n_shingles = 0").select(F.col("row_key").alias("_row_key")).distinct())
    rows = df.withColumn("_row_key", F.xxhash64(key, text)).dropDuplicates(["_row_key"])
    return rows.join(chosen, "_row_key", "left_semi").drop("_row_key")


def _labels(members: DataFrame, sketches: DataFrame, sets: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """(node, label) of all classes with a link, by comparing bucket mates whose labels differ."""
    words = [f"s{i}" for i in range(SKETCH)]

    def side(frame: DataFrame, name: str, *more: str) -> DataFrame:
        return frame.select(F.col("cid").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", *words)), *more)

    # sizes and sketches that leave a similarity of num / den possible
    possible = F.expr(
        f"least(a_n, b_n) * {den} >= greatest(a_n, b_n) * {num} AND "
        f"({' + '.join(f'bit_count(a_{w} ^ b_{w})' for w in words)}) * {den + num} <= (a_n + b_n) * {den - num}")

    def long_possible(pairs: DataFrame) -> DataFrame:
        left, right = (sketches.select(F.col("cid").alias(c), F.col("n").alias(f"{c}_n"), F.col("long").alias(f"{c}_long")) for c in "ab")
        both = pairs.join(left, "a").join(right, "b").select("a", "b", F.expr("a_n + b_n").alias("total"), "a_long", "b_long")
        return stored(both.mapInArrow(partial(_possible, num=num, den=den), "a long, b long"), "pairs")

    def compare(pairs: DataFrame, grams: DataFrame) -> DataFrame:
        left = grams.select(F.col("cid").alias("a"), F.col("grams").alias("left"))
        right = grams.select(F.col("cid").alias("b"), F.col("grams").alias("right"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        return both.mapInArrow(partial(_verified, num=num, den=den), "a long, b long, linked boolean")

    labels, tested, links, compared = None, None, None, []
    for turn in range(PIVOT_ROUNDS + 1):
        now = members
        if labels is not None:
            now = members.join(labels, F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cid")).drop("node")
        else:
            now = members.withColumn("label", F.col("cid"))
        order = F.xxhash64("cid", F.lit(turn))
        heads = now.groupBy("value").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), *(
                F.min_by(F.when(F.col("exact"), F.col(c)), F.when(F.col("exact"), order)).alias(f"p_{c}") for c in ("cid", "label")))
        heads, met = heads.where("low < high").drop("low", "high"), None
        if turn < PIVOT_ROUNDS:
            pairs = now.join(heads, "value").where("label <> p_label")
            pairs = pairs.select(F.least("cid", "p_cid").alias("a"), F.greatest("cid", "p_cid").alias("b")).distinct()
            pairs = pairs.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").where(possible).select("a", "b")
        else:
            # sketches go along only here, with the values that are still open
            met = stored(now.join(heads.select("value"), "value").join(sketches.select("cid", "n", *words), "cid"), "open")
            left = side(met, "a", "value", F.col("label").alias("la"), F.col("exact").alias("a_exact"))
            right = side(met, "b", "value", F.col("label").alias("lb"), F.col("exact").alias("b_exact"))
            pairs = left.join(right, (left["value"] == right["value"]) & F.expr("a_exact AND la <> lb AND (a < b OR NOT b_exact)") & possible)
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        near = stored(pairs, "near")
        pairs = long_possible(near)
        grams = sets(pairs.selectExpr("explode(array(a, b)) AS cid").distinct())
        found = stored(compare(pairs, grams), "compared")
        tested = found if tested is None else tested.unionByName(found)
        links = tested.where("linked")
        old, labels = labels, components(links)
        discard(met, near, pairs, grams, old)
        compared.append(found)
    discard(members, sketches, *compared)
    return labels


@query("op2_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=90, den=100)

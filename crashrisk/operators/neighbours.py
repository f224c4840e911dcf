"""Exact k nearest neighbours of every row among the rows of its group, by cells round pivots.

Rows with equal vectors are one spot first. The spots of a group are split into cells:
each spot goes to the nearest of up to ``FAN`` pivots, which are spots of the cell chosen
by hash, and cells that are still too large are split again. Every cell knows its pivot,
its radius and how many spots it holds.

A spot is compared with all of its own cell first. The distance of the k-th nearest found
so far, or of the k-th nearest pivot met on the way down, bounds how far a neighbour can
be. A second pass walks down the cells and goes on only where the triangle inequality
leaves a neighbour possible: where the cell's ball comes within the bound, and where the
border to the nearest pivot beside it does. Cells left over are compared in blocks of
``PROBES`` spots with one cell, so no task holds more than such a block, whatever the
number of spots that meet a cell. The answer is that of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashrisk.session import materialise

#: Pivots of a cell that is split, and levels of splits at most (4 bits of a cell's number each).
FAN, DEPTH = 16, 14
#: Spots of a cell that is not split, and spots compared with one cell at a time.
LEAF_POINTS, PROBES = 256, 1024
#: Decimals of squared distances; nearer ones than this tell rows apart by their key.
DECIMALS = 9
_SLACK = 2e-9
#: What is known of a probe on its way down the cells, besides its group and cell.
_FRONT = ["_p", "_z", "bound", "own"]


def _distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def _first(df: DataFrame, by: list[str], order: list[Column], n: int, place: str) -> DataFrame:
    """The first ``n`` rows of each group with their place; Spark cuts the groups down before it shuffles them."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= n)


def _split(spots: DataFrame, k: int, leaf_points: int) -> tuple[DataFrame, DataFrame | None]:
    """(spots with their cell and a bound on the k-th distance, children of each split cell)."""
    cells = spots.select("_g", "_p", "_z", F.lit(1).cast("long").alias("cell"), F.lit(float("inf")).alias("bound"))
    settled, levels = [], []
    for depth in range(DEPTH):
        large = cells.groupBy("_g", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_points).select("_g", "cell")
        pivots = _first(cells.join(large, ["_g", "cell"], "left_semi"), ["_g", "cell"], [F.xxhash64("_p", F.lit(depth)), F.col("_p")], FAN, "i")
        pivots = pivots.groupBy("_g", "cell").agg(F.array_sort(F.collect_list(F.struct("i", "_z"))).alias("pivots"))
        placed = materialise(cells.join(pivots, ["_g", "cell"], "left"))
        settled.append(placed.where("pivots IS NULL").select("_g", "_p", "_z", "cell", "bound"))
        inner = placed.where("pivots IS NOT NULL").withColumn(
            "away", F.transform("pivots", lambda p, i: F.struct(_distance(F.col("_z"), p["_z"]).alias("d"), i.alias("i"))))
        others = F.array_sort(F.filter(F.transform("away", lambda a: a["d"]), lambda x: x > 0))
        inner = inner.select(
            "_g", "_p", "_z", "cell", "pivots", F.array_min("away").alias("to"),
            F.least("bound", F.when(F.size(others) >= k, F.get(others, F.lit(k - 1))).otherwise(float("inf"))).alias("bound"))
        inner = materialise(inner.select("_g", "_p", "_z", "cell", "bound", (F.col("cell") * FAN + F.col("to.i")).alias("child"), F.col("to.d").alias("d"),
                                         F.get(F.col("pivots"), F.col("to.i"))["_z"].alias("pivot")))
        children = inner.groupBy("_g", "cell", "child").agg(F.max("d").alias("radius"), F.count(F.lit(1)).alias("n"), F.any_value("pivot").alias("pivot"))
        if children.isEmpty():
            break
        levels.append(children)
        cells = inner.select("_g", "_p", "_z", F.col("child").alias("cell"), "bound")
    else:
        settled.append(cells)
    leaves = settled[0]
    for more in settled[1:]:
        leaves = leaves.unionByName(more)
    if not levels:
        return leaves, None
    tree = levels[0]
    for more in levels[1:]:
        tree = tree.unionByName(more)
    inside = tree.select("_g", F.col("cell").alias("child"), F.lit(True).alias("inside")).distinct()
    tree = tree.join(inside, ["_g", "child"], "left").groupBy("_g", "cell").agg(F.collect_list(F.struct(
        "child", "radius", "pivot", F.coalesce("inside", F.lit(False)).alias("inside"))).alias("children"))
    return leaves, materialise(tree)


def _nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of (one cell's spots, a block of probes) as the k nearest members found for each probe."""
    for batch in batches:
        for i in range(batch.num_rows):
            held, probes = batch.column("held")[i].values, batch.column("probes")[i].values
            vectors = [_matrix(rows.field("_z")) for rows in (held, probes)]
            squared = np.zeros((len(probes), len(held)))
            for a, b in zip(vectors[1].T, vectors[0].T):  # axis after axis, as a plain sum would
                squared += (a[:, None] - b[None]) ** 2
            squared = np.floor(squared * 10 ** DECIMALS + 0.5) / 10 ** DECIMALS
            own = {p: j for j, p in enumerate(held.field("_p").to_pylist())}
            for row, spot in zip(squared, probes.field("_p").to_pylist()):
                if spot in own:
                    row[own[spot]] = np.inf
            members = held.field("members")
            sizes = members.value_lengths().to_numpy(zero_copy_only=False)
            owner, ids = np.repeat(np.arange(len(held)), sizes), members.flatten()
            by_name = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
            bounds = probes.field("bound").to_numpy(zero_copy_only=False)
            # members in the order of their keys, so that of equal distances the smaller key comes first
            away = squared[:, owner[by_name]]
            away[np.isnan(away)] = np.inf
            place = min(k, away.shape[1]) - 1
            most = np.minimum(np.partition(away, place, axis=1)[:, place], bounds * bounds + _SLACK)
            row, at = np.nonzero((away <= most[:, None]) & np.isfinite(away))
            order = np.lexsort((away[row, at], row))
            row, at = row[order], at[order]
            near = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, at = row[near], at[near]
            ends = pa.array(np.searchsorted(row, np.arange(len(probes) + 1)).astype(np.int32))
            found = pa.StructArray.from_arrays([pa.array(away[row, at]), ids.take(pa.array(by_name[at]))], ["d", "other"])
            yield pa.record_batch([pa.array([batch.column("_g")[i].as_py()] * len(probes), batch.schema.field("_g").type), probes.field("_p"),
                                   pa.ListArray.from_arrays(ends, found)], names=["_g", "_p", "found"])


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(vectors), len(values) // max(1, len(vectors)))


def _blocks(probes: DataFrame, fields: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """(one row per block of the probes that meet a cell, number of blocks of each cell)."""
    sizes = probes.groupBy("_g", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = probes.join(sizes, ["_g", "cell"]).withColumn("block", F.pmod(F.xxhash64("_p"), F.col("blocks")))
    return dealt.groupBy("_g", "cell", "block").agg(F.collect_list(F.struct(*fields)).alias("probes")), sizes


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (one cell's children, a block of probes) as the children in which a probe may have a neighbour."""
    for batch in batches:
        for i in range(batch.num_rows):
            children, probes = batch.column("children")[i].values, batch.column("probes")[i].values
            squared = np.zeros((len(probes), len(children)))
            for a, b in zip(_matrix(probes.field("_z")).T, _matrix(children.field("pivot")).T):
                squared += (a[:, None] - b[None]) ** 2
            away, radius = np.sqrt(squared), children.field("radius").to_numpy(zero_copy_only=False)
            bound = probes.field("bound").to_numpy(zero_copy_only=False)[:, None] + 1e-9
            row, at = np.nonzero((away - radius <= bound) & ((away - away.min(axis=1, keepdims=True)) / 2 <= bound))
            met, cells = probes.take(pa.array(row)), children.take(pa.array(at))
            yield pa.record_batch([pa.array([batch.column("_g")[i].as_py()] * len(row), batch.schema.field("_g").type),
                                   *(met.field(c) for c in _FRONT), cells.field("child"), cells.field("inside")], names=["_g", *_FRONT, "cell", "inside"])


def _descend(front: DataFrame, tree: DataFrame, block: int) -> DataFrame:
    """(_g, _p, _z, bound, own, cell, inside): each probe with the children of its cells that it has to look into."""
    packed, sizes = _blocks(front, _FRONT, block)
    # all probes meet the first cell, so its children are dealt out with the blocks
    dealt = tree.join(sizes, ["_g", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    types = {f.name: f.dataType.simpleString() for f in front.schema.fields}
    return packed.join(dealt, ["_g", "cell", "block"]).select("_g", "children", "probes").mapInArrow(
        _below, ", ".join(f"{c} {types[c]}" for c in ("_g", *_FRONT)) + ", cell long, inside boolean")


def _compare(probes: DataFrame, cells: DataFrame, k: int, block: int) -> DataFrame:
    """(_g, _p, found) of each probe in each of its cells; ``cells`` has one packed row per cell."""
    packed, _ = _blocks(probes, ["_p", "_z", "bound"], block)
    types = {f.name: f.dataType.simpleString() for f in probes.schema.fields}
    rows = packed.join(cells, ["_g", "cell"]).select("_g", "held", "probes")
    return rows.mapInArrow(partial(_nearest, k=k), f"_g {types['_g']}, _p {types['_p']}, found array<struct<d: double, other: {types['_p']}>>")


def nearest_neighbours(rows: DataFrame, group: str, key: str, vector: str, k: int, leaf_points: int = LEAF_POINTS, probes: int = PROBES) -> DataFrame:
    """(group, key, neighbours): the nearest ``k`` other rows of the group as (d, other), d being the squared distance.

    Squared distances are rounded to ``DECIMALS`` places, ties go to the smaller key. Keys are
    unique and not null, vectors have one length and no nulls; rows without a group are left
    out. A group with fewer than k + 1 rows gives what there is.
    """
    rows = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(key).alias("_id"), F.col(vector).alias("_z"))
    rows = materialise(rows)
    # k + 1 rows of a spot are enough for all of them: the nearest are on the spot itself
    spots = _first(rows, ["_g", "_z"], [F.col("_id")], k + 1, "_n").groupBy("_g", "_z").agg(F.array_sort(F.collect_list("_id")).alias("members"))
    spots = materialise(spots.withColumn("_p", F.col("members")[0]))
    leaves, tree = _split(spots, k, leaf_points)
    leaves = materialise(leaves.join(spots.select("_g", "_p", "members"), ["_g", "_p"]))
    cells = materialise(leaves.groupBy("_g", "cell").agg(F.collect_list(F.struct("_p", "_z", "members")).alias("held")))

    found = materialise(_compare(leaves.select("_g", "cell", "_p", "_z", "bound"), cells, k, probes))
    if tree is not None:
        worst = F.when(F.size("found") >= k, F.sqrt(F.get("found", F.lit(k - 1))["d"] + _SLACK)).otherwise(float("inf"))
        front = leaves.join(found, ["_g", "_p"]).select("_g", "_p", "_z", F.least("bound", worst).alias("bound"), F.col("cell").alias("own"),
                                                        F.lit(1).cast("long").alias("cell"))
        reached = []
        for _ in range(DEPTH):
            met = materialise(_descend(front, tree, probes))
            reached.append(met.where("NOT inside AND cell <> own").select("_g", "cell", "_p", "_z", "bound"))
            front = met.where("inside").select("_g", "_p", "_z", "bound", "own", "cell")
            if front.isEmpty():
                break
        pairs = reached[0]
        for more in reached[1:]:
            pairs = pairs.unionByName(more)
        found = found.unionByName(_compare(pairs, cells, k, probes))
    best = _first(found.select("_g", "_p", F.inline("found")), ["_g", "_p"], [F.col("d"), F.col("other")], k, "_n")
    best = best.groupBy("_g", "_p").agg(F.collect_list(F.struct("d", "other")).alias("others"))
    told = spots.join(best, ["_g", "_p"], "left").select("_g", "_z", "members", F.coalesce("others", F.array().cast(best.schema["others"].dataType)).alias("others"))
    here = F.transform(F.filter("members", lambda m: m != F.col("_id")), lambda m: F.struct(F.lit(0.0).alias("d"), m.alias("other")))
    return rows.join(told, ["_g", "_z"]).select(
        F.col("_g").alias(group), F.col("_id").alias(key), F.slice(F.array_sort(F.concat(here, "others")), 1, k).alias("neighbours"))

"""Hard negatives by vantage-point trees over norm-augmented vectors.

A component more, the square root of M * M - |x| * |x|, gives all rows the norm M, so that an anchor's inner product with a
row falls as their distance grows: a window of scores is an annulus round the anchor. A tree of vantage points, fitted on
a bounded sample, deals all rows to regions; each is known by the ranges of its rows' distances to the vantage points. An
anchor first searches the region that promises most, then those that can still hold better rows by the triangle
inequality. Inside a region, rows hang on a tree of their own; its buckets are opened nearest first, from the inner
radius outwards, until none can improve the k rows found. Scores are whole numbers; distances only decide what is opened,
with a margin for rounding, so the result is exact and the order ties by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped_since, mark, written

#: Rows that the upper tree is fitted on (those of the smallest hashes), and its regions at most.
SAMPLE, REGIONS = 4096, 256
#: Rows of a region that are searched by one task, and anchors that meet them there; more are split by the hash of their id.
BLOCK, QUERIES = 16_384, 16_384
#: Rows of a bucket of a region's own tree.
BUCKET = 128
#: The norm that rows must stay below to take part, so that every score fits in 64 bits; scores beyond any row's.
LARGEST_NORM, BEYOND = 2.0**31, 1 << 62
#: Stands for no score.
NONE = -(1 << 63) + 1

#: A query: an anchor's label, id and vector, the row it belongs to (a positive, or the anchor), and the scores it wants:
#: from low to high, none below worst.
QUERY = ["dim", "label", "id", "positive", "low", "high", "worst", "vec"]
FOUND = "id long, positive long, other long, score long"


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component, in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def searchable(rows: DataFrame, anchor: Column, key: str, label: str, vector: str) -> DataFrame:
    """The rows that take part: (dim, label, id, vec, anchor), one for each id."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    square = F.aggregate(x, F.lit(0.0), lambda total, v: total + F.pow(F.floor(v.cast("double") * 256).cast("double"), 2))
    own = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & finite & (square < LARGEST_NORM**2))
    own = own.select(F.col(key).cast("long").alias("id"), F.struct(F.size(x).alias("dim"), F.col(label).cast("long").alias("label"), integers(x).alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor")).alias("row"))
    return own.groupBy("id").agg(F.min("row").alias("row")).select("row.dim", "row.label", "id", "row.vec", "row.anchor")


def representatives(rows: DataFrame, most: int) -> DataFrame:
    """Of the rows of a label with one vector, those of the smallest ids: with so many, no other can be among the first."""
    same = [F.xxhash64("vec"), F.xxhash64(F.reverse("vec"))]
    by = Window.partitionBy("dim", "label", *same).orderBy("id")
    return rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= most).drop("n")


def matrix(vectors, dim: int) -> np.ndarray:
    """An Arrow or pandas column of vectors of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False) if isinstance(vectors, pa.Array) else np.concatenate([np.empty(0), *vectors])
    return flat.astype(np.float64).reshape(len(vectors), dim)


def augmented(x: np.ndarray, square: float) -> np.ndarray:
    """Vectors with the component that gives all the same norm."""
    return np.column_stack([x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))])


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Of each of x to each point (with one component more than x if these are anchors, whose further one is 0)."""
    wide = points[:, : x.shape[1]]
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None] - 2 * x @ wide.T, 0))


class Tree:
    """Vantage points over some vectors, split at the median distance down to leaves of a given size.

    points: the vantage points. paths: for each leaf its (point, whether outside) from the top. Equal distances may fall on
    both sides, so a leaf never exceeds its size; of what lies in a leaf only ranges of distances are used.
    """

    def __init__(self, x: np.ndarray, size: int):
        self.points, self.cuts, self.paths, self.members = [], [], [], []
        self._split(x, np.arange(len(x)), size, [])
        self.points = np.array(self.points).reshape(-1, x.shape[1])

    def _split(self, x: np.ndarray, own: np.ndarray, size: int, path: list) -> None:
        if len(own) <= size:
            self.paths.append(path)
            self.members.append(own)
            return
        middle = x[own].mean(axis=0)
        point = x[own[((x[own] - middle) ** 2).sum(axis=1).argmax()]]  # a far one, which spreads the distances
        far = distances(x[own], point[None])[:, 0]
        order = np.argsort(far, kind="stable")
        half = len(own) // 2
        number = len(self.points)
        self.points.append(point)
        self.cuts.append(float(far[order[half]]))
        self._split(x, own[order[:half]], size, [*path, (number, False)])
        self._split(x, own[order[half:]], size, [*path, (number, True)])

    def leaf_of(self, far: np.ndarray) -> np.ndarray:
        """The leaf of each row, by its distances to all points."""
        out = np.zeros(len(far), np.int64)
        for leaf, path in enumerate(self.paths):
            here = np.ones(len(far), bool)
            for number, outside in path:
                here &= (far[:, number] >= self.cuts[number]) == outside
            out[here] = leaf
        return out


def bounds(far: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest distance that an anchor can have to the rows of each region.

    far: anchors by points; low and high: regions by points, the range of the distances of a region's rows.
    """
    near = np.zeros((len(far), len(low)))
    wide = np.full((len(far), len(low)), np.inf)
    for p in range(far.shape[1]):
        d = far[:, p, None]
        np.maximum(near, np.maximum(low[None, :, p] - d, d - high[None, :, p]), out=near)
        np.minimum(wide, d + high[None, :, p], out=wide)
    return near, wide


def score_bounds(q: np.ndarray, near: np.ndarray, wide: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
    """The largest and least score that distances allow, with a margin for rounding."""
    total = (q * q).sum(axis=1)[:, None] + square
    margin = 1e-9 * total + 1e-6
    return (total - near * near) / 2 + margin, (total - wide * wide) / 2 - margin


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly."""
    if math.sqrt(float((q * q).sum(axis=1).max(initial=0)) * float((x * x).sum(axis=1).max(initial=0))) < 1 << 52:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _fits(anchor: np.ndarray, own: np.ndarray, same: bool) -> np.ndarray:
    """Which rows an anchor can take: (label, id) of anchors and rows."""
    if same:
        return (anchor[:, None, 0] == own[None, :, 0]) & (anchor[:, None, 1] != own[None, :, 1])
    return anchor[:, None, 0] != own[None, :, 0]


def nearest(q: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, worst: np.ndarray, x: np.ndarray, own: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor the k rows of most score (ties by id) among those it can take, with a score from low to high.

    worst: a score below which rows are not wanted. Rows (anchor, row, score) in any order. Buckets of the rows' tree are
    opened nearest first, a growing number at a time, all anchors of a bucket together.
    """
    square = float((x * x).sum(axis=1).max(initial=0))
    full = augmented(x, square)
    tree = Tree(full, BUCKET)
    far = distances(full, tree.points)
    least, most = (np.array([pick(far[rows], axis=0) for rows in tree.members]) for pick in (np.min, np.max))
    best, rest = score_bounds(q, *bounds(distances(q, tree.points), least, most), square)
    hope = np.minimum(best, high[:, None])
    hope[(rest > high[:, None]) | (best < low[:, None])] = -np.inf
    order = np.argsort(-hope, axis=1, kind="stable")
    found_s = np.full((len(q), k), NONE)
    found_i = np.full((len(q), k), -1)
    bar = np.maximum(low, worst).astype(np.float64)  # what a bucket must be able to reach
    active, at, step = np.arange(len(q)), 0, 1
    while len(active) and at < order.shape[1]:
        picked = order[active, at : at + step]
        promising = np.take_along_axis(hope[active], picked, axis=1) >= bar[active, None]
        where, slot = np.nonzero(promising)
        leaves = picked[where, slot]
        by = np.argsort(leaves, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(leaves[by])) + 1):
            if len(part):
                who, rows = active[where[part]], tree.members[leaves[part[0]]]
                s = scores(q[who], x[rows])
                ok = _fits(anchor[who], own[rows], same) & (s >= low[who, None]) & (s <= high[who, None]) & (s >= bar[who, None])
                if len(hit := np.flatnonzero(ok.any(axis=1))):
                    to, ok = who[hit], ok[hit]
                    both_s = np.concatenate([found_s[to], np.where(ok, s[hit], NONE)], axis=1)
                    both_i = np.concatenate([found_i[to], np.where(ok, rows[None], -1)], axis=1)
                    top = _first(both_s, np.where(both_i >= 0, own[both_i, 1], BEYOND), k)
                    found_s[to], found_i[to] = np.take_along_axis(both_s, top, axis=1), np.take_along_axis(both_i, top, axis=1)
                    held = to[found_i[to, k - 1] >= 0]
                    bar[held] = np.maximum(bar[held], found_s[held, k - 1])
        at += step
        step *= 2
        if at < order.shape[1]:
            active = active[hope[active, order[active, at]] >= bar[active]]
    a, slot = np.nonzero(found_i >= 0)
    return a, found_i[a, slot], found_s[a, slot]


def _first(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the first k stand in each row, by score downwards and id upwards."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    by_score = np.argsort(-np.take_along_axis(s, by_id, axis=1), axis=1, kind="stable")
    return np.take_along_axis(by_id, by_score, axis=1)[:, :k]


def _searched(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The first k rows of a block for each query that came to it."""
    if rows.empty or queries.empty:
        return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("id", "positive", "other", "score")})
    dim = int(key[0])
    ids = lambda df: df[["label", "id"]].to_numpy(np.int64)
    a, r, score = nearest(matrix(queries["vec"], dim), ids(queries), *(queries[c].to_numpy(np.int64) for c in ("low", "high", "worst")), matrix(rows["vec"], dim), ids(rows), k, same)
    return pd.DataFrame({"id": queries["id"].to_numpy()[a], "positive": queries["positive"].to_numpy()[a], "other": rows["id"].to_numpy()[r], "score": score})


class Regions:
    """The upper tree of each length of vectors that the sample holds; other lengths are one region each."""

    def __init__(self, rows: DataFrame):
        """rows: (dim, label, id, vec). To the driver go the sample, a number of rows and the largest norm."""
        found = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda total, v: total + F.pow(v.cast("double"), 2))).alias("square")).first()
        self.square = float(found.square or 0)
        sample = rows.select("dim", "id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        size = max(SAMPLE // REGIONS, math.ceil(len(sample) * BLOCK / max(1, found.n)))
        self.trees, self.ranges = {}, {}
        for dim in {r.dim for r in sample}:
            self.trees[dim] = Tree(augmented(matrix([np.array(r.vec) for r in sample if r.dim == dim], dim), self.square), size)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows with their region."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column(0).to_numpy()
                for dim in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == dim))
                    tree = self.trees.get(dim)
                    far = tree and distances(augmented(matrix(part.column(3), dim), self.square), tree.points)
                    region = tree.leaf_of(far) if tree else np.zeros(part.num_rows, np.int64)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(region.astype(np.int32))], names=[*part.schema.names, "region"])

        return rows.mapInArrow(deal, "dim int, label long, id long, vec array<long>, region int")

    def measure(self, rows: DataFrame) -> None:
        """Takes in how far the rows of each region are from the vantage points: two numbers for each region and point."""

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, regions = batch.column(0).to_numpy(), batch.column(4).to_numpy()
                for dim in sorted({*np.unique(dims).tolist()} & {*self.trees}):
                    tree, mine = self.trees[dim], dims == dim
                    far = distances(augmented(matrix(batch.column(3).filter(pa.array(mine)), dim), self.square), tree.points)
                    there, points = np.unique(regions[mine]), len(tree.points)
                    low, high = (np.array([pick(far[regions[mine] == r], axis=0) for r in there]).reshape(-1) for pick in (np.min, np.max))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(low), dim, np.int32)), pa.array(np.repeat(there, points)), pa.array(np.tile(np.arange(points, dtype=np.int32), len(there))), pa.array(low), pa.array(high)], names=["dim", "region", "point", "low", "high"])

        found = rows.mapInArrow(ranges, "dim int, region int, point int, low double, high double").groupBy("dim", "region", "point").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
        for dim, tree in self.trees.items():
            low, high = np.zeros((2, len(tree.paths), len(tree.points)))
            high[:] = np.inf
            self.ranges[dim] = low, high
        for r in found:
            self.ranges[r.dim][0][r.region, r.point], self.ranges[r.dim][1][r.region, r.point] = r.low, r.high

    def visited(self, queries: DataFrame, home: bool) -> DataFrame:
        """Queries with a region for each that they go to: the one that promises most, or all others that can help."""

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column(0).to_numpy()
                for dim in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == dim))
                    if dim not in self.trees:
                        who, region = (np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)) if home else (np.empty(0, np.int64),) * 2
                    else:
                        low, high, worst = (part.column(i).to_numpy() for i in (4, 5, 6))
                        q = matrix(part.column(7), dim)
                        best, rest = score_bounds(q, *bounds(distances(q, self.trees[dim].points), *self.ranges[dim]), self.square)
                        hope = np.minimum(best, high[:, None])
                        hope[(rest > high[:, None]) | (best < low[:, None])] = -np.inf
                        first = hope.argmax(axis=1)
                        if home:
                            who, region = np.arange(len(q)), first
                        else:
                            hope[np.arange(len(q)), first] = -np.inf
                            who, region = np.nonzero(hope >= np.maximum(low, worst)[:, None])
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(who)).columns, pa.array(region.astype(np.int32))], names=[*QUERY, "region"])

        return queries.select(*QUERY).mapInArrow(visit, "dim int, label long, id long, positive long, low long, high long, worst long, vec array<long>, region int")


def _parts(rows: DataFrame, most: int, name: str) -> DataFrame:
    """(dim, region, number of parts) of regions with more than most rows: at most one for each so many rows."""
    counts = rows.groupBy("dim", "region").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    return counts.where(F.col(name) > 1)


def _met(rows: DataFrame, visits: DataFrame, k: int, same: bool) -> DataFrame:
    """What the queries find in the regions they visit. A region's rows are split into blocks, each query meets all of
    them; many queries are split too, each block meets all of these: so a task holds one block and one part."""
    key = ["dim", "region"]
    blocks, shares = written(_parts(rows, BLOCK, "blocks")), written(_parts(visits, QUERIES, "shares"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    one = lambda n, *by: F.pmod(F.xxhash64(*by), F.coalesce(F.col(n), F.lit(1))).cast("int")
    both = lambda df: df.join(blocks, key, "left").join(shares, key, "left")
    left = both(rows).withColumns({"block": one("blocks", "id"), "share": each("shares")}).drop("blocks", "shares")
    right = both(visits).withColumns({"block": each("blocks"), "share": one("shares", "id", "positive")}).drop("blocks", "shares")
    key = [*key, "block", "share"]

    def search(own: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _searched(own, a, b, k, same)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("id", "positive").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def first_rows(regions: Regions, rows: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """Of each query the first k rows (of its own label and another id, or of another label): (id, positive, other, score,
    rank). Queries go to one region first; what they find there says which others can still help."""
    queries = queries.withColumn("worst", F.lit(-BEYOND).cast("long"))
    home = written(_met(rows, written(regions.visited(queries, home=True)), k, same))
    bar = _best(home, k).where(F.col("rank") == k).select("id", "positive", F.col("score").alias("bar"))
    rest = queries.join(bar, ["id", "positive"], "left").withColumn("worst", F.coalesce("bar", "worst"))
    far = _met(rows, written(regions.visited(rest, home=False)), k, same)
    return _best(home.unionByName(far), k)


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are the first rows of its label, its negatives the first of other labels whose score is from least
    to most per cent of the positive's; higher scores come first, then smaller ids. Scores are inner products of whole
    numbers (see integers). Rows with a null id, label or vector, with a null or non-finite component, or of a norm of
    LARGEST_NORM or more take no part; of several rows of one id, the one of the least length, label and vector does. Only
    vectors of one length are compared. An anchor without positives, or without negatives in any window, has no rows.
    """
    spark, point = rows.sparkSession, mark()
    own = written(searchable(rows, anchor, key, label, vector))
    few = representatives(own.drop("anchor"), max(positives + 1, negatives))
    regions = Regions(few)
    dealt = written(regions.dealt(few.select("dim", "label", "id", "vec")))
    regions.measure(dealt)
    begun = mark()
    asked = own.where("anchor").select("dim", "label", "id", F.col("id").alias("positive"), F.lit(-BEYOND).cast("long").alias("low"), F.lit(BEYOND).cast("long").alias("high"), "vec")
    near = written(first_rows(regions, dealt, asked, positives, same=True).select("id", F.col("other").alias("positive"), F.col("score").alias("positive_score")))
    dropped_since(spark, begun, near)
    whole, left = F.expr("positive_score div 100"), F.col("positive_score") % 100
    share = lambda percent, up: whole * percent + ((left * percent + up) / 100).cast("long")
    windows = near.where("positive_score >= 0").withColumns({"low": share(least, 99), "high": share(most, 0)})
    asked = windows.join(own.where("anchor").drop("anchor"), "id").select("dim", "label", "id", "positive", "low", "high", "vec")
    found = first_rows(regions, dealt, asked, negatives, same=False).join(near, ["id", "positive"])
    out = written(found.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    dropped_since(spark, point, out)
    return out

"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one node. Seeds of the neighbour graph come from sorted random projections; rounds of
NN-descent then join, at each node, its neighbours with one another and keep the best of each. The
lists only steer the search: every link among the vectors that a block or a node brings together goes, as a forest, to
the components, whatever its rank. A list that is full of links is saturated: it may grow twofold in each round, and at
last to the whole component, whose links are all counted exactly, block by block.
An audit of each searched group compares nodes of it with all others by brute force: mean recall per node, apart for
nodes of few and of many links. Below the wanted recall, the group is searched from more projections, and at last
compared completely. Pairs below the threshold are never links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY, components, dropped, heavy_join, spread, written

#: Neighbours in a list at first, and rounds of neighbours-of-neighbours joins.
NEIGHBOURS, ROUNDS = 8, 3
#: Random projections of the first search, and those that each further search adds.
TABLES = 8
#: Rows in projection order that are compared with one another for seeds.
SEED_BLOCK = 512
#: Neighbours below this cosine are not followed.
FOLLOWED = 0.5
#: Nodes of one block of a component when links are counted.
COUNT_BLOCK = 2048
#: For each group and class of found links (none, up to FEW, more), nodes that the audit compares with the whole group;
#: the recall it asks for, and searches before a group that falls short is compared completely.
AUDITED, FEW, RECALL, SEARCHES = 512, 8, 0.995, 4

#: grp: label and length, within which vectors are compared.
NODES = "node long, grp string, mult long, vec binary"
#: cos: null where the pair was not measured; link: whether links connect the two.
EDGES = "u long, v long, cos double, link boolean"


def unit(blobs: list[bytes]) -> np.ndarray:
    """Vectors of one length, scaled to norm 1 in double precision."""
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [np.array(v, np.float64).tobytes() for v in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(blobs, pa.binary())], names=["node", "grp", "mult", "vec"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[tuple[tuple, list[list]]]:
    """Columns of rows with equal leading keys, in runs of at most the given number; rows come sorted by the keys."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for key, own in groupby(rows, key=lambda r: r[:keys]):
        held: list[tuple] = []
        for r in own:
            held.append(r)
            if len(held) == most:
                yield key, [list(c) for c in zip(*held)]
                held = []
        if held:
            yield key, [list(c) for c in zip(*held)]


def _best(nodes: np.ndarray, x: np.ndarray, least: float, most: int) -> tuple[list[int], list[int], list[float]]:
    """For each of few vectors, the others of most cosine: rows (u, v, cosine)."""
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    k = min(most, len(nodes) - 1)
    if k < 1:
        return [], [], []
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(cos, near, axis=1)
    r, c = np.nonzero(value >= least)
    return nodes[r].tolist(), nodes[near[r, c]].tolist(), value[r, c].tolist()


def _joined(near: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its part) that connect the nodes of rows and columns as the true cells do."""
    free, ids, roots = near.any(axis=1), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while free.any():
        at, left, right = np.array([np.argmax(free)]), [], np.zeros(len(cols), bool)
        while len(at):
            free[at] = False
            left.append(rows[at])
            hit = near[at].any(axis=0) & ~right
            right |= hit
            at = np.flatnonzero(free & near[:, hit].any(axis=1))
        own = np.unique(np.concatenate([*left, cols[right]]))
        ids.append(own[1:])
        roots.append(np.full(len(own) - 1, own[0]))
    return np.concatenate(ids), np.concatenate(roots)


def _edges(nodes: np.ndarray, x: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Rows (u, v, cos, link): the best pairs of few vectors, which steer the search, and a forest of all their links (cos null)."""
    u, v, cos = _best(nodes, x, FOLLOWED, NEIGHBOURS)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    a, b = _joined(near, nodes, nodes)
    return pa.RecordBatch.from_arrays([pa.array(u + a.tolist(), pa.int64()), pa.array(v + b.tolist(), pa.int64()), pa.array(cos + [None] * len(a), pa.float64()), pa.array([False] * len(u) + [True] * len(a), pa.bool_())], names=["u", "v", "cos", "link"])


def seeds(nodes: DataFrame, threshold: float, first: int) -> DataFrame:
    """Rows (u, v, cos, link) of near pairs among rows that lie close in the order of some projection.

    nodes have n, the number of nodes of their group, by which the group is cut.
    """

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(3).to_pylist()
            size = np.array([len(b) // 8 for b in blobs], np.int64)
            cut = np.array([max(0, math.ceil(math.log2(n / (8 * SEED_BLOCK)))) for n in batch.column(4).to_pylist()], np.int64)
            for dim, bits in sorted(set(zip(size.tolist(), cut.tolist()))):
                at = np.flatnonzero((size == dim) & (cut == bits))
                x = unit([blobs[i] for i in at])
                rows = batch.take(pa.array(at))
                for t in range(first, first + TABLES):
                    planes = np.random.Generator(np.random.PCG64(t)).standard_normal((dim, bits + 1))
                    p = x @ planes
                    code = ((p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros(len(at), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t)), rows.column(1), pa.array(code.astype(np.int64)), pa.array(p[:, bits]), rows.column(0), rows.column(3)], names=["t", "grp", "code", "at", "node", "vec"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in _groups(batches, 3, SEED_BLOCK):
            if len(cols[4]) > 1:
                yield _edges(np.array(cols[4]), unit(cols[5]), threshold)

    rows = nodes.mapInArrow(projected, "t long, grp string, code long, at double, node long, vec binary")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by range, so that a code of very many rows is cut at places in its own order
    return rows.repartitionByRange(n, "t", "grp", "code", "at").sortWithinPartitions("t", "grp", "code", "at", "node").mapInArrow(compared, EDGES)


def best_lists(edges: DataFrame, threshold: float, size: int, grown: int) -> DataFrame:
    """The size best neighbours of each node, or up to grown where the first size are all links; edges marked as links all stay."""
    pairs = edges.groupBy("u", "v").agg(F.max("cos").alias("cos"), F.max("link").alias("link"))
    by = Window.partitionBy("u").orderBy(F.desc("cos"), "v")
    ranked = pairs.withColumn("rank", F.row_number().over(by))  # pairs without a cosine come last
    listed = F.col("cos").isNotNull() & (F.col("rank") <= grown) & ((F.col("rank") <= size) | (F.col("cos") >= threshold))
    return ranked.where(listed | F.col("link")).drop("rank")


def descended(graph: DataFrame, nodes: DataFrame, threshold: float, size: int) -> DataFrame:
    """The graph after one round: the neighbours of each node, both ways, are compared with one another."""
    steering = graph.where(F.col("cos").isNotNull())
    both = steering.select(F.col("u").alias("m"), F.col("v").alias("nb"), "cos").unionByName(steering.select(F.col("v").alias("m"), F.col("u").alias("nb"), "cos")).groupBy("m", "nb").agg(F.max("cos").alias("cos"))
    by = Window.partitionBy("m").orderBy(F.desc("cos"), "nb")
    around = both.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= 2 * size).select("m", "nb")
    around = around.join(nodes.select(F.col("node").alias("nb"), "vec"), "nb").select("m", "nb", "vec")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in _groups(batches, 1, 4 * size):
            if len(cols[1]) > 1:
                yield _edges(np.array(cols[1]), unit(cols[2]), threshold)

    new = spread(around, "m").sortWithinPartitions("m").mapInArrow(joined, EDGES)
    return best_lists(graph.unionByName(new), threshold, NEIGHBOURS, size)


def in_blocks(members: DataFrame, key: str) -> DataFrame:
    """Rows (key, i, j, own, node, mult, vec): each pair of blocks of the nodes of a key in one place, sorted by block."""
    sizes = members.groupBy(key).agg(F.ceil(F.count("*") / COUNT_BLOCK).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = members.select(key, "node", "mult", "vec").join(sizes, key).select(key, own.alias("own"), F.explode(meet).alias("w"), "node", "mult", "vec")
    return spread(dealt.select(key, "w.i", "w.j", "own", "node", "mult", "vec"), key, "i", "j").sortWithinPartitions(key, "i", "j", "own")


def linked_whole(nodes: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) that connect all that the links of each group connect, by all pairs in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), cols in _groups(batches, 3, 1 << 62):
            own, node, x = np.array(cols[3]), np.array(cols[4]), unit(cols[6])
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            near = (x[left] @ x[right].T) >= threshold
            if i == j:
                np.fill_diagonal(near, False)
            u, v = _joined(near, node[left], node[right])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return in_blocks(nodes, "grp").mapInArrow(run, "u long, v long")


def counted(members: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, linked): how many vectors of other nodes each node of a component links with, by all pairs in blocks.

    members: rows (component, node, mult, vec).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), cols in _groups(batches, 3, 1 << 62):
            own, node, mult, x = np.array(cols[3]), np.array(cols[4]), np.array(cols[5], np.float64), unit(cols[6])
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            near = (x[left] @ x[right].T) >= threshold
            if i == j:
                np.fill_diagonal(near, False)
                found, at = near @ mult, left
            else:
                found, at = np.concatenate([near @ mult[right], near.T @ mult[left]]), np.concatenate([left, right])
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(found.astype(np.int64))], names=["node", "linked"])

    return in_blocks(members, "component").mapInArrow(run, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def short(nodes: DataFrame, linked: DataFrame, threshold: float) -> DataFrame:
    """Rows (grp) of the groups whose nodes of few or of many links have, by estimate, a mean recall below RECALL.

    nodes have n, the number of nodes of their group. Nodes are asked by hash, AUDITED of each class of found links,
    and count by the size of their class; nodes without true links don't count.
    """
    found = F.coalesce("linked", F.lit(0))
    got = written(nodes.join(linked, "node", "left").select("node", "grp", "mult", "vec", "n", found.alias("found"), F.when(found == 0, 0).when(found <= FEW, 1).otherwise(2).alias("class")))
    by = Window.partitionBy("grp", "class").orderBy(F.xxhash64("node"), "node")
    asked = written(got.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= AUDITED).drop("rank"))
    blocks = F.ceil(F.col("n") / COUNT_BLOCK).cast("int")
    every = asked.select("grp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b"), F.lit(True).alias("asks"), "node", "mult", "vec")
    others = got.select("grp", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("b"), F.lit(False).alias("asks"), "node", "mult", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in _groups(batches, 2, 1 << 62):
            asks, node, mult, x = np.array(cols[2]), np.array(cols[3]), np.array(cols[4], np.int64), unit(cols[5])
            near = (x[asks] @ x[~asks].T >= threshold) & (node[asks][:, None] != node[~asks][None])
            yield pa.RecordBatch.from_arrays([pa.array(node[asks]), pa.array((near @ mult[~asks]).astype(np.int64))], names=["node", "actual"])

    true = spread(every.unionByName(others), "grp", "b").sortWithinPartitions("grp", "b").mapInArrow(run, "node long, actual long").groupBy("node").agg(F.sum("actual").alias("actual"))
    weights = got.groupBy("grp", "class").agg(F.count("*").alias("all"))
    weights = weights.withColumn("weight", F.col("all") / F.least("all", F.lit(AUDITED)))
    rated = asked.select("node", "grp", "class", "found").join(true.where(F.col("actual") > 0), "node").join(weights, ["grp", "class"])
    recall = rated.groupBy("grp", (F.col("actual") <= FEW).alias("few")).agg((F.sum(F.col("weight") * F.col("found") / F.col("actual")) / F.sum("weight")).alias("recall"))
    return recall.where(F.col("recall") < RECALL).select("grp").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors.

    Vectors link if their labels are equal and not null and their cosine in double precision reaches the threshold;
    vectors of different lengths never link, nor do null, empty or zero vectors and those with null or non-finite
    components. Repeated rows are vectors like any other. Extra columns are ignored; an empty table gives no rows.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    fit = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    key = [F.xxhash64("label", "v").alias("k1"), F.xxhash64("v", "label").alias("k2")]  # two hashes tell classes apart
    good, rest = raw.where(fit), raw.where(~fit)
    classes = written(good.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult")))
    nodes = written(classes.select("node", F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string")).alias("grp"), "mult", "v").mapInArrow(_packed, NODES))
    left = written(nodes.groupBy("grp").agg(F.count("*").alias("n")))
    links, graph, searched = None, None, 0
    while searched < SEARCHES and not left.isEmpty():
        own = written(nodes.join(left, "grp").select("node", "grp", "mult", "vec", "n"))
        new = seeds(own, threshold, searched * TABLES)
        graph = written(best_lists(new if graph is None else graph.unionByName(new), threshold, NEIGHBOURS, NEIGHBOURS))
        for r in range(1, ROUNDS + 1):
            last, graph = graph, written(descended(graph, own, threshold, NEIGHBOURS << r))
            dropped(last)
        new = written(graph.where(F.col("link") | (F.col("cos") >= threshold)).select("u", "v"))
        links = new if links is None else links.unionByName(new)
        parts = written(components(links, "u", "v"))
        linked = written(counted(parts.join(own, "node").select("component", "node", "mult", "vec"), threshold))
        left = written(left.join(short(own, linked, threshold), "grp", "left_semi"))
        searched += 1
    if links is None:  # no vector may link
        links = nodes.select(F.col("node").alias("u"), F.col("node").alias("v"))
        parts, linked = components(links, "u", "v"), nodes.select("node", F.lit(0).cast("long").alias("linked"))
    if not left.isEmpty():
        links = links.unionByName(linked_whole(nodes.join(left, "grp", "left_semi"), threshold))
    if searched > 1 or not left.isEmpty():  # else all nodes were searched once, and this is what there is
        parts = written(components(links, "u", "v"))
        linked = written(counted(parts.join(nodes, "node").select("component", "node", "mult", "vec"), threshold))
    found = classes.join(linked, "node", "left").join(parts, "node", "left")
    found = written(found.select(*key, "mult", (F.col("mult") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    ids = good.select("vec_id", *key)
    total = found.agg(F.sum("mult")).first()[0] or 0
    out = heavy_join(ids, found.drop("mult"), ["k1", "k2"], found.where(F.col("mult") > max(1, total // HEAVY))).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    dropped(classes, nodes)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))

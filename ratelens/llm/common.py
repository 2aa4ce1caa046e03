"""What the operators share: reading columns, shared tables, Arrow text and linked components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of text that a Python worker handles at once (a longer text is handled alone).
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _folder_of_this_process() -> str:
    return "file://" + tempfile.mkdtemp(prefix="ratelens-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    Where it is unset, a session within one process (local mode, as in tests) gets a folder of its own; others fail, as
    no machine's folder is seen by all executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _folder_of_this_process()
    return found.rstrip("/")


#: Paths of the tables of written() that are not dropped yet, in the order in which they were made.
_kept: list[str] = []


@contextlib.contextmanager
def _shuffles_go_at_the_end(spark: SparkSession) -> Iterator[None]:
    """Executions in here delete their shuffle files when they are done, instead of when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _kept.append(path)
    with _shuffles_go_at_the_end(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _kept.remove(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "shared_path", None)) in _kept:
            _deleted(df.sparkSession, path)


def mark() -> int:
    """A point in time for dropped_since()."""
    return len(_kept)


def dropped_since(spark: SparkSession, point: int, *but: DataFrame) -> None:
    """Deletes the tables that were written since a mark, those given excepted; nothing may read them any more."""
    stay = {getattr(df, "shared_path", None) for df in but}
    for path in _kept[point:]:
        if path not in stay:
            _deleted(spark, path)


@atexit.register
def _clean() -> None:
    """The tables behind results that were handed out go with the process, if its session still runs."""
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):  # the session may be ending too
        for path in [*_kept]:
            _deleted(spark, path)


def fresh(df: DataFrame, n: int) -> list[str]:
    """Column names that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    return list(itertools.islice((x for i in itertools.count() if (x := f"own_{i}") not in taken), n))


def text_key(text: Column) -> list[Column]:
    """Two numbers of 64 and 63 bits that tell texts apart."""
    return [F.xxhash64(text), F.crc32(text) * F.lit(1 << 31) + F.hash(text)]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by the hash of the keys over the session's number of partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Most keys that can each hold more than one row in HEAVY of a table.
HEAVY = 1000


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame) -> DataFrame:
    """left joined with right, which has at most one row for each key.

    heavy: the keys with more than one in HEAVY of left's rows, so at most HEAVY rows, which bounds the broadcasts. Rows of
    these keys stay where they are, the others are shuffled.
    """
    few = F.broadcast(heavy.select(*keys))
    cold = left.join(few, keys, "left_anti").join(right, keys)
    return cold.unionByName(left.join(few, keys, "left_semi").join(F.broadcast(right.join(few, keys, "left_semi")), keys))


def text_column(name: str = "text") -> Column:
    """A text column, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(sizes: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to at most the bound, single rows excepted."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column without nulls, and the offsets of its rows in them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@functools.cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # no glibc
        return lambda _: 0


def release() -> None:
    """Gives a Python worker's unused memory back, as idle workers stay beside those of later stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_groups(batch: pa.RecordBatch, name: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a record batch of about CHUNK_BYTES (or most) of text each; at the end, unused memory goes back to the system."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes, most or CHUNK_BYTES):
        yield batch.slice(a, b - a)
    release()


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit multipliers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE, _BASE = odd_numbers(256, 11), odd_numbers(1, 13)[0]
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
MIX = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the hashes of the runs from starts to ends in the bytes; equal runs of any data have equal ones."""
    power = np.full(len(data) + 1, _BASE)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[1:], out=total[1:])
    power[1:] = _BACK
    np.cumprod(power, out=power)  # now the way back: what stands at a start counts as if it stood at 0

    def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = (total[ends] - total[starts]) * power[starts] * MIX
        return (found ^ (found >> np.uint64(31))) * MIX + (ends - starts).astype(np.uint64)

    return of


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its part) that connect what the given edges connect."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = _forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Rows (node, component) of linked nodes, component being the smallest node that can be reached.

    Large-star and small-star rounds (Kiveris et al., 2014) over a written edge table, after each task has reduced
    its own edges to a forest. A centre with very many edges (heavy_join) keeps them where they are. No node, edge or
    component reaches the driver; nodes without an edge have no row.
    """
    e = edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).cast("long").alias("a"), F.least(left, right).cast("long").alias("b"))
    e = written(e.mapInArrow(_local_forests, "a long, b long").distinct())

    def hung_on(rows: DataFrame, centre: str, low: DataFrame, most: int) -> DataFrame:
        return heavy_join(rows, low.select(centre, "m"), [centre], low.where(F.col("rows") > most))

    before = None
    while True:
        count = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if count == before or not count.n:
            break
        before, most = count, max(1, count.n // HEAVY)
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("rows"))
        large = hung_on(both, "u", low, most).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        high = written(large.where("a <> b").distinct())
        low = high.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows"))
        small = hung_on(high, "a", low, most).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = written(small.where("a <> b").distinct())
        dropped(e, high)
        e = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())


def public_path(name: str) -> str:
    """Where a public tokenizer's file lies; each executor has its own installed copy."""
    import public_tokenizers

    return public_tokenizers.path(name)

"""SimHash near-duplicates by the general pigeonhole principle.

The 64 fingerprint bits are grouped into parts, correlated bits together. If the thresholds t_i of the parts satisfy
sum(t_i + 1) = radius + 1, two fingerprints within the radius differ by at most t_i bits in some part i (a part with
t_i = -1 is not looked at). Number of parts and thresholds are chosen by dynamic programming on estimated candidate
counts; then each fingerprint is stored under its part values and probes the values within t_i bits, and every candidate
is verified on all bits. Of two values that differ, the one whose lowest differing bit is 0 probes the other, so a
fingerprint sends half of the values around its own. 64 bits can't tell near-duplicates from the chance neighbours of very
many documents; where texts are to be dropped, candidates are verified on 192 further bits of the same kind as well, and
texts are one node only if all 256 bits are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, MIX, _forest, components, dropped, fresh, heavy_join, odd_numbers, raw_texts, spread, text_column, text_groups, text_key, written

BITS, SHINGLE, SEED = 64, 4, 42
#: Columns of the further bits, and the multipliers that turn a shingle's hash into those behind them.
WIDE = ["w0", "w1", "w2"]
#: The node that a row stands for: the fingerprint, or where further bits count, a hash of all bits.
NODE = "node"
_TURNS = odd_numbers(len(WIDE), 17)
#: Fingerprints whose bit statistics guide the plan. Any plan gives the same result; this only steers its cost.
SAMPLE = 2048
#: Largest block of fingerprints that meet under one part value; values with more are split into pairs of blocks.
BLOCK = 8192
#: Candidate pairs that a task verifies at once.
PAIRS = 1 << 20
#: Cost of storing or probing a row, in verified candidates.
ROW_COST = 800.0


def text_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of a text's words."""
    words = text.lower().split()  # both touch ASCII only: A-Z, and blanks \x20 \x09-\x0D
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]


def fingerprints(hashes: list[list[int]]) -> np.ndarray:
    """Majority fingerprints (unsigned) of lists of hashes; an empty list gives zero."""
    return _majorities(np.array([x for h in hashes for x in h], np.uint64), np.array([len(h) for h in hashes], np.int64))


def wide_fingerprints(hashes: list[list[int]]) -> list[np.ndarray]:
    """The fingerprints of fingerprints(), and those of the WIDE columns."""
    flat, sizes = np.array([x for h in hashes for x in h], np.uint64), np.array([len(h) for h in hashes], np.int64)
    mixed = [(flat ^ (flat >> np.uint64(32))) * turn for turn in _TURNS]
    return [_majorities(x, sizes) for x in (flat, *[(m ^ (m >> np.uint64(29))) * MIX for m in mixed])]


def _majorities(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), np.uint64)
    has = np.flatnonzero(sizes)
    if not len(has):
        return out
    heads = np.concatenate([[0], np.cumsum(sizes[has])[:-1]])
    for byte in range(8):
        part = ((flat >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)
        ones = np.add.reduceat(np.unpackbits(part[:, None], axis=1, bitorder="little"), heads, axis=0, dtype=np.int64)
        bits = np.packbits(2 * ones > sizes[has][:, None], axis=1, bitorder="little")[:, 0]
        out[has] |= bits.astype(np.uint64) << np.uint64(8 * byte)
    return out


def _fingerprint_rows(shingle: int, wide: list[str]):
    """Rows (doc_id, k1, k2, text) to rows (doc_id, k1, k2, fp), with the wide columns behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_groups(batch):
                data, offsets = raw_texts(part.column(3))
                flat, at = data.tobytes(), offsets.tolist()
                hashes = [text_hashes(flat[a:b], shingle) for a, b in zip(at[:-1], at[1:])]
                prints = wide_fingerprints(hashes) if wide else [fingerprints(hashes)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array(p.view(np.int64)) for p in prints]], names=["doc_id", "k1", "k2", "fp", *wide])

    return run


def grouped_bits(prints: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of almost equal size, each grown from the bit that correlates most with those still free."""
    x = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    x -= x.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0))
    norm[norm == 0] = 1
    link = np.abs((x / norm).T @ (x / norm))
    np.fill_diagonal(link, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        own = [max(free, key=lambda b: (link[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            best = max(free, key=lambda b: (link[b, own].sum(), -b))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def choose(prints: np.ndarray, total: int, radius: int) -> list[tuple[int, int]]:
    """The plan (bit mask of a part, threshold) of least estimated cost for a number of fingerprints."""
    if not len(prints):
        return [((1 << BITS) - 1, radius)]
    left, right = np.triu_indices(len(prints), 1)
    differing = prints[left] ^ prints[right]
    pairs = total * (total - 1) / 2
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(2, radius + 2):
        masks = [sum(1 << b for b in own) for own in grouped_bits(prints, parts)]
        # dynamic programming over parts: least cost for each amount of sum(t + 1) spent so far
        state: dict[int, tuple[float, list]] = {0: (0.0, [])}
        for mask in masks:
            width = mask.bit_count()
            near = np.bincount(np.bitwise_count(differing & np.uint64(mask)), minlength=BITS + 1).cumsum()
            step: dict[int, tuple[float, list]] = {}
            for spent, (cost, plan) in state.items():
                for t in range(-1, min(2, radius - spent) + 1):
                    if spent + t + 1 > radius + 1:
                        continue
                    if t < 0:
                        more = 0.0
                    else:
                        ball = sum(comb(width, k) for k in range(t + 1))
                        rate = max(near[t] / max(1, len(differing)), ball / 2.0**width)
                        more = pairs * rate + ROW_COST * total * (1 + ball) / 2  # stored once, and half of the rest
                    new = (cost + more, [*plan, (mask, t)])
                    if spent + t + 1 not in step or new[0] < step[spent + t + 1][0]:
                        step[spent + t + 1] = new
            state = step
        if radius + 1 in state and state[radius + 1][0] < best[0]:
            best = state[radius + 1]
    return [(mask, t) for mask, t in best[1] if t >= 0]


def probe_masks(mask: int, t: int) -> list[int]:
    """Differences of 1 to t bits within a part."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [sum(c) for k in range(1, t + 1) for c in combinations(bits, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lowest(flips: np.ndarray) -> np.ndarray:
    """The lowest bit of each that is set."""
    return flips & (~flips + np.uint64(1))


def _stored_and_probing(plan: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [(i, np.uint64(mask), np.array(probe_masks(mask, t), np.uint64)) for i, (mask, t) in enumerate(plan)]
        for batch in batches:
            prints, *more = (c.to_numpy().view(np.uint64) for c in batch.columns)
            for i, mask, flips in masks:
                value = prints & mask
                yield _rows(i, value, prints, True, more)
                for flip, low in zip(flips, _lowest(flips)):
                    own = np.flatnonzero(prints & low == 0)
                    yield _rows(i, value[own] ^ flip, prints[own], False, [m[own] for m in more])

    return run


_MET = f"part int, key long, fp long, stored boolean, {NODE} long"


def _rows(part: int, key: np.ndarray, prints: np.ndarray, stored: bool, more: list[np.ndarray]) -> pa.RecordBatch:
    n = len(key)
    longs = [pa.array(x.view(np.int64)) for x in (key, prints, *more)]
    cols = [pa.array(np.full(n, part, np.int32)), *longs[:2], pa.array(np.full(n, stored)), *longs[2:]]
    return pa.RecordBatch.from_arrays(cols, names=["part", "key", "fp", "stored", NODE, *WIDE[: len(more) - 1]])


def _verifier(plan: list[tuple[int, int]], radius: int, verify: int | None):
    """Verifies, in rows sorted by their meeting place, all pairs of a left and a right row."""
    masks = np.array([mask for mask, _ in plan], np.uint64)

    def links(fp: np.ndarray, place: np.ndarray, probing: np.ndarray, left: np.ndarray, right: np.ndarray, node: np.ndarray, more: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        l, r = np.flatnonzero(left), np.flatnonzero(right)
        low, high = np.searchsorted(place[r], place[l], "left"), np.searchsorted(place[r], place[l], "right")
        count = high - low
        total = np.cumsum(count)
        at = 0
        while at < len(l):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            n = count[at:stop]
            a = np.repeat(l[at:stop], n)
            first = np.cumsum(n) - n
            b = r[np.repeat(low[at:stop] - first, n) + np.arange(len(a))]
            # a probing row is the only one of its pair to meet the other here; two stored ones would meet twice
            near = np.flatnonzero((probing[a] | (node[a] < node[b])) & (np.bitwise_count(fp[a] ^ fp[b]) <= radius))
            a, b = a[near], b[near]
            if verify is not None:
                near = sum(np.bitwise_count(w[a] ^ w[b]) for w in more) <= verify  # at most 192, so bytes suffice
                a, b = a[near], b[near]
            if len(a):
                x, y = _forest(node[a], node[b])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if not len(held[0]):
                held = None
                continue
            same = np.ones(len(held[0]), bool)
            for c in held[:4]:
                same &= c == c[-1]
            n = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last place may go on
            if n:
                yield from places([c[:n] for c in held])
                held = [c[n:] for c in held]
        if held is not None:
            yield from places(held)

    def places(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:4]:
            new[1:] |= c[1:] != c[:-1]
        prints = cols[4].view(np.uint64)
        probing = prints & masks[cols[0]] != cols[1].view(np.uint64)
        yield from links(prints, np.cumsum(new), probing, cols[5], cols[6], cols[7], [c.view(np.uint64) for c in cols[8:]])

    return run


def _around(plan: list[tuple[int, int]]):
    """Rows (part, key, own) to rows (part, key, met): the rows that the fingerprints of a value send to it and around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [np.array([0, *probe_masks(mask, t)], np.uint64) for mask, t in plan]
        for batch in batches:
            part, key, own = (c.to_numpy() for c in batch.columns)
            for i, around in enumerate(flips):
                at = np.flatnonzero(part == i)
                for flip, low in zip(around, _lowest(around)):
                    to = at[key[at].view(np.uint64) & low == 0]
                    met = (key[to].view(np.uint64) ^ flip).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part[to]), pa.array(met), pa.array(own[to])], names=["part", "key", "met"])

    return run


def _hot(prints: DataFrame, plan: list[tuple[int, int]]) -> DataFrame:
    """Rows (part, key, n, m): values where more than BLOCK rows may meet, with the numbers of blocks of all rows and of stored ones.

    Only stored rows are counted. Values with few of them send at most BLOCK rows to any one value, all together, so the rows
    that the others send decide; no value left out meets more than 2 BLOCK rows.
    """
    around = max(1 + len(probe_masks(mask, t)) for mask, t in plan)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")) for i, (mask, _) in enumerate(plan)]))
    own = written(prints.select(each.alias("at")).groupBy("at.part", "at.key").agg(F.count("*").alias("own")))
    met = own.where(F.col("own") > BLOCK / around).mapInArrow(_around(plan), "part int, key long, met long").groupBy("part", "key").agg(F.sum("met").alias("all"))
    met = met.where(F.col("all") > BLOCK).join(own, ["part", "key"])
    return met.select("part", "key", F.ceil(F.col("all") / BLOCK).cast("int").alias("n"), F.ceil(F.col("own") / BLOCK).cast("int").alias("m"))


def linked_prints(prints: DataFrame, radius: int, verify: int | None = None) -> DataFrame:
    """Links (a, b) that connect all nodes within the radius of one another, and within verify of the further bits.

    prints: one row (fp, and with verify node and the WIDE columns) for each node; without verify, node is fp. Not every pair is a row: each task reduces
    the pairs it has verified to a forest, which connects the same nodes.
    """
    prints = prints if verify is not None else prints.withColumn(NODE, F.col("fp"))
    total = prints.count()
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    wide = [] if verify is None else WIDE
    plan = choose(sample, total, radius)
    rows = prints.select("fp", NODE, *wide).mapInArrow(_stored_and_probing(plan), ", ".join([_MET, *[f"{w} long" for w in wide]]))
    hot = written(_hot(prints, plan))
    dealt = rows.join(hot, ["part", "key"], "left")
    at_left, at_right = (F.pmod(F.xxhash64(NODE), F.coalesce(c, F.lit(1))).cast("int") for c in ("n", "m"))
    as_left = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(at_left.alias("i"), j.alias("j"), F.lit(True).alias("l"), F.lit(False).alias("r")))
    as_right = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("i"), at_right.alias("j"), F.lit(False).alias("l"), F.lit(True).alias("r")))
    once = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("l"), F.col("stored").alias("r")))
    where = F.when(F.col("n").isNull(), once).when(F.col("stored"), F.concat(as_left, as_right)).otherwise(as_left)
    meeting = dealt.select("part", "key", "fp", NODE, *wide, F.explode(where).alias("at")).select("part", "key", "at.i", "at.j", "fp", "at.l", "at.r", NODE, *wide)
    meeting = spread(meeting, "part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")
    return meeting.mapInArrow(_verifier(plan, radius, verify), "a long, b long")


def grouped_rows(docs: DataFrame, radius: int, shingle: int, id_col: str, text_col: str, verify: int | None = None) -> DataFrame:
    """Rows (doc_id, k1, k2, fp, component_id), one for each row of docs; k1 and k2 are the text's key.

    Texts of one fingerprint, and with verify of the same further bits, are one node.
    """
    wide = [] if verify is None else WIDE
    text = text_column(text_col)
    k1, k2 = text_key(text)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    found = picked.mapInArrow(_fingerprint_rows(shingle, wide), ", ".join(f"{c} long" for c in ["doc_id", "k1", "k2", "fp", *wide]))
    found = written(found.withColumn(NODE, F.xxhash64("fp", *wide) if wide else F.col("fp")))
    prints = written(found.groupBy(NODE, "fp", *wide).agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")))
    parts = prints.select(F.col(NODE).alias("own"), "low", "rows").join(components(linked_prints(prints, radius, verify), "a", "b"), F.col("own") == F.col("node"), "left")
    parts = written(parts.select(F.col("own").alias(NODE), "low", "rows", F.coalesce("component", "own").alias("part")))
    ids = parts.groupBy("part").agg(F.min("low").alias("component_id"), F.count("*").alias("prints"))
    named = written(heavy_join(parts, ids.select("part", "component_id"), ["part"], ids.where(F.col("prints") > max(1, parts.count() // HEAVY))).select(NODE, "rows", "component_id"))
    dropped(prints, parts)
    found = found.select("doc_id", "k1", "k2", "fp", NODE)
    out = heavy_join(found, named.select(NODE, "component_id"), [NODE], named.where(F.col("rows") > max(1, found.count() // HEAVY)))
    return out.select("doc_id", "k1", "k2", "fp", "component_id")


def simhash_components(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of docs.

    component_id is the smallest doc_id reachable over links of at most radius differing bits. A text without words
    (null, empty, blanks only) has fingerprint zero and is linked like any other. Rows are linked by their fingerprints
    alone: repeated rows and rows of one id with other texts are rows like any other, and rows without an id link too
    (component_id is null if no row that they reach has an id). Extra columns are ignored; an empty table gives no rows.
    Documents of one fingerprint are one node, so groups of copies cost one row.
    """
    rows = grouped_rows(docs, radius, shingle, id_col, text_col)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, verify: int | None = None) -> DataFrame:
    """One row of each group of near-duplicates, with its columns, whatever their names: the row with the smallest id.

    Links have at most radius differing bits of 64 and, if verify is given, at most verify of 192 further ones.

    Of several rows of a group with that id (repeated rows, or other texts of one id), the one with the smallest text hash
    stays; equal rows are one. Rows without an id stay. An empty table gives no rows.
    """
    own = docs.where(F.col(id_col).isNotNull())
    first = grouped_rows(own, radius, shingle, id_col, text_col, verify).where("doc_id = component_id")
    first = first.groupBy("component_id", "doc_id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("doc_id", "k.*").distinct()
    i, k1, k2, row = fresh(docs, 4)
    keyed = own.withColumns({i: F.col(id_col).cast("long")} | dict(zip((k1, k2), text_key(text_column(text_col)))))
    kept = keyed.join(first.toDF(i, k1, k2), [i, k1, k2], "left_semi")
    # repeated rows: partial aggregates leave one of each task
    kept = kept.groupBy(i, k1, k2).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias(row)).select(f"{row}.*")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))

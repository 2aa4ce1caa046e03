"""Quality by perplexity: an interpolated modified Kneser-Ney bigram model of words, trained on trusted text.

Words are runs of letters and digits or of marks, with no fixed alphabet or vocabulary, so the model grows with the
trusted text. All its counts cover all trusted documents and meet in shards: word pairs by their context, continuation
counts by their word (Chen and Goodman, 1998). Pairs seen less than LEAST times count in every total, but have no entry of
their own: their mass goes to the lower order.

With g(v) the weight that context v leaves to the lower order, the log-probability of a text is a plain sum over its
words and pairs, each looked up alone:

    log p(w|v) = log p0 + [log p1(w) - log p0] + log g(v) + [log p2(w|v) - log g(v) - log p1(w)]

where an entry that the model lacks adds 0 (p0: an unknown word). So a document's perplexity is a count join: the different
words and pairs of a chunk of documents go to the shards of the model, and the sums come back. Documents are handled in
WAVES, by a hash of the text, which bounds the disk that the words and pairs take while they move.

A document's score is its loss per word, drawn towards its language's mean by PRIOR words, so that short texts need
stronger evidence. Its density is the score (the mean at least, as known text is not held against a document) times the
share of its word pairs that are no repeats within the document. The score may reach an upper quantile, and the density must reach a lower one, by language, of trusted documents that the
counts have not seen: strange text fails the first, text that says one thing over and over the second.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh, raw_texts, run_hashes, slices, spread, text_column, text_groups, text_key, written

#: Least count of a word pair with an entry of its own.
LEAST = 2
#: Words of evidence that a language's mean stands for, and those that the mean of all languages adds to a language's own.
PRIOR, PRIOR_MEAN = 50, 2000
#: Share of trusted texts (of 100, by their hash) that set thresholds instead of counting.
HELD_OUT = 20
#: Quantile of the held-out trusted scores and of their densities (from below), a margin (nats per word) above the first,
#: and the share of the second that is enough: long documents repeat pairs too, empty repetition lies far lower.
QUANTILE, MARGIN, ENOUGH = 0.995, 0.05, 0.75
#: Held-out documents up to which quantiles are exact.
ACCURACY = 1_000_000
#: Held-out documents of a language whose own quantiles weigh as much as those of all languages.
LANGUAGE_WEIGHT = 50
#: Parts of the word pairs that are counted, and of the texts that are scored, one after another.
WAVES = 4
#: Most trusted ids that are broadcast to find their texts; more of them meet the texts by a shuffled join.
BROADCAST_IDS = 1_000_000
#: Bytes of text whose different words and pairs are sent together, and those that are hashed at once.
CHUNK, SEGMENT = 1 << 22, 1 << 20
#: Model entries of a shard, about.
SHARD = 2_000_000
#: Hashes that stand before the first word and behind the last.
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_KIND = np.array([0 if c <= 32 or c == 127 else 1 if c >= 128 or chr(c).isalnum() else 2 for c in range(256)], np.uint8)
#: Leading bytes of characters that are words of their own, as their scripts set no blanks.
_ALONE = (0xE3, 0xED)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of texts that lie one after another, and the text it is of."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = _KIND[data]
    new = np.append(True, kind[1:] != kind[:-1])
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    alone = np.flatnonzero((data >= _ALONE[0]) & (data <= _ALONE[1]))
    new[alone] = True
    new[alone[alone + 3 < len(data)] + 3] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    own = kind[starts] > 0
    starts, ends = starts[own], ends[own]
    return run_hashes(data)(starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def _parts(data: np.ndarray) -> list[tuple[int, int]]:
    """A long text in parts of about SEGMENT bytes that end behind a blank (an unbroken run stays whole)."""
    out, at = [], 0
    while len(data) - at > SEGMENT:
        end = at + SEGMENT
        while end < len(data):
            blank = np.flatnonzero(data[end : end + SEGMENT] <= 32)
            if len(blank):
                end += int(blank[0]) + 1
                break
            end = min(len(data), end + SEGMENT)
        out.append((at, end))
        at = end
    return [*out, (at, len(data))]


def pairs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (text, context, word) of the words and end marks of texts, a bounded number of bytes at a time."""
    for a, b in slices(np.diff(offsets), SEGMENT):
        own = data[offsets[a] : offsets[b]]
        if b == a + 1 and len(own) > SEGMENT:
            before = START
            every = _parts(own)
            for i, (low, high) in enumerate(every):
                found, _ = words(own[low:high], np.array([0, high - low]))
                if i + 1 == len(every):
                    found = np.append(found, END)
                if len(found):
                    yield np.full(len(found), a), np.append(before, found[:-1]), found
                    before = found[-1]
            continue
        found, text = words(own, offsets[a : b + 1] - offsets[a])
        size = np.bincount(text, minlength=b - a) + 1
        word = np.full(int(size.sum()), END)
        word[np.arange(len(found)) + text] = found
        context = np.append(START, word[:-1])
        context[np.cumsum(size) - size] = START
        yield np.repeat(np.arange(a, b), size), context, word


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return context ^ ((word << np.uint64(17)) | (word >> np.uint64(47)))


def _pair_column(context: str, word: str) -> Column:
    return F.col(context).bitwiseXOR(F.shiftleft(word, 17).bitwiseOR(F.shiftrightunsigned(word, 47)))


def _counted(wave: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the pairs of a wave's contexts: rows (v, w, n), one for each pair of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_groups(batch, most=CHUNK):
                data, offsets = raw_texts(part.column(0))
                v, w = [], []
                for _, context, word in pairs(data, offsets):
                    mine = (context >> np.uint64(32)) % np.uint64(WAVES) == wave
                    v.append(context[mine])
                    w.append(word[mine])
                v, w = np.concatenate(v), np.concatenate(w)
                _, at, n = np.unique(pair_key(v, w), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)), pa.array(w[at].view(np.int64)), pa.array(n)], names=["v", "w", "n"])

    return run


def discounts(of: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of entries counted 1 to 4 times; sparse counts are kept within bounds."""
    n1, n2, n3, n4 = (max(1, of.get(i, 0)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), 0.95 * k) for d, k in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (3 - 4 * y * n4 / n3, 3)))


def _small_counts(counts: DataFrame) -> dict[int, int]:
    return {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}


def trained(texts: DataFrame) -> tuple[DataFrame, float]:
    """The model of the texts (a column text): rows (key, value) of its words, contexts and pairs, and log p0."""
    often, contexts, ends, of = [], [], [], {}
    for wave in range(WAVES):
        own = written(texts.select("text").mapInArrow(_counted(wave), "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n")))
        contexts.append(written(own.groupBy("v").agg(F.sum("n").alias("total"), *[F.count_if(c).alias(x) for x, c in (("c1", F.col("n") == 1), ("c2", F.col("n") == 2), ("c3", F.col("n") > 2))])))
        ends.append(written(own.groupBy("w").agg(F.count("*").alias("n"))))
        often.append(written(own.where(F.col("n") >= LEAST)))
        for n, k in _small_counts(own).items():
            of[n] = of.get(n, 0) + k
        dropped(own)
    d2 = discounts(of)

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def off(d: tuple[float, float, float]) -> Column:
        return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])

    word_counts = written(union(ends).groupBy("w").agg(F.sum("n").alias("n")))
    d1 = discounts(_small_counts(word_counts))
    total, size, left = word_counts.agg(F.sum("n"), F.count("*"), F.sum(off(d1))).first()
    p0 = left / total / (size + 1)
    known = word_counts.select("w", ((F.col("n") - off(d1)) / total + p0).alias("p1"))
    kept = [F.col(c) * (1.0 if i + 1 < LEAST else d) for i, (c, d) in enumerate(zip(("c1", "c2", "c3"), d2))]
    leaving = written(union(contexts).select("v", "total", (sum(kept[1:], kept[0]) / F.col("total")).alias("g")))
    own = union(often).join(leaving, "v").join(known, "w")
    p2 = (F.col("n") - off(d2)) / F.col("total") + F.col("g") * F.col("p1")
    rows = own.select(_pair_column("v", "w").alias("key"), F.log(p2 / (F.col("g") * F.col("p1"))).alias("value"))
    rows = rows.unionByName(known.select(F.col("w").alias("key"), F.log(F.col("p1") / p0).alias("value"))).unionByName(leaving.select(F.col("v").alias("key"), F.log("g").alias("value")))
    model = written(rows.groupBy(F.shiftrightunsigned("key", 16).alias("key")).agg(F.sum("value").alias("value")))
    dropped(word_counts, leaving, *often, *contexts, *ends)
    return model, float(np.log(p0))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of keys of 48 bits; rises with the key."""
    return ((keys >> np.uint64(16)) * np.uint64(shards)) >> np.uint64(32)


def sharded(model: DataFrame, shards: int) -> DataFrame:
    """The model as rows (shard, kind 0, chunk null, blob): each shard's sorted keys and their values."""
    shard = F.shiftright(F.shiftright("key", 16) * shards, 32).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def row() -> pa.RecordBatch:
            key, value = (np.concatenate(x) for x in zip(*[h[1:] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), pa.array([0], pa.int32()), pa.array([None], pa.int64()), pa.array([key.tobytes() + value.tobytes()], pa.binary())], names=_NAMES)

        for batch in batches:
            number, key, value = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else []
            for a, b in zip(cuts, [*cuts[1:], len(number)]):
                if held and held[0][0] != number[a]:
                    yield row()
                    held = []
                held.append([int(number[a]), key[a:b], value[a:b].astype(np.float32)])
        if held:
            yield row()

    return spread(model.select(shard.alias("shard"), "key", "value"), "shard").sortWithinPartitions("shard", "key").mapInArrow(run, _ROWS)


#: kind 0: a shard of the model; 1: words and pairs of a chunk that fall to the shard; 2: the texts of a chunk.
_ROWS = "shard int, kind int, chunk long, blob binary"
_NAMES = ["shard", "kind", "chunk", "blob"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, so that the shuffle's compression drops the empty ones."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(blob: memoryview, kind: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(-1, n).T).view(kind).reshape(n)


def _requests(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (k1, k2, lang, text) to rows of kind 1 and 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for group in text_groups(batch, most=CHUNK):
                for first in range(0, len(group), 1 << 16):
                    part = group.slice(first, 1 << 16)
                    data, offsets = raw_texts(part.column(3))
                    single, double, size = [], [], np.zeros(len(part), np.int64)
                    for text, context, word in pairs(data, offsets):
                        size += np.bincount(text, minlength=len(part))
                        for found, key, own in ((single, word, slice(None)), (double, pair_key(context, word), slice(None)), (single, context, np.flatnonzero(context == START))):
                            found.append(((key[own] >> np.uint64(16)) << np.uint64(16)) | text[own].astype(np.uint64))
                    double, times = np.unique(np.concatenate(double), return_counts=True)
                    different = np.bincount((double & np.uint64(0xFFFF)).astype(np.int64), minlength=len(part))
                    single, n = np.unique(np.concatenate(single), return_counts=True)
                    key, n = np.concatenate([single, double]), np.concatenate([n, times])
                    order = np.argsort(key, kind="stable")
                    key, n = key[order], n[order]
                    cuts = np.searchsorted(shard_of(key >> np.uint64(16), shards), np.arange(shards + 1))
                    rows = []
                    for s in np.flatnonzero(np.diff(cuts)).tolist():
                        own = key[cuts[s] : cuts[s + 1]]
                        step = np.append(own[:1], np.diff(own))
                        rows.append((s, 1, number, len(own).to_bytes(8, "little") + _planes(step) + _planes(n[cuts[s] : cuts[s + 1]].astype(np.uint32))))
                    texts = pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(size), pa.array(different)], names=["k1", "k2", "lang", "n", "pairs"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, texts.schema) as out:
                        out.write_batch(texts)
                    rows.append((number % shards, 2, number, sink.getvalue().to_pybytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)
                    number += 1

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and kind to rows (chunk, kind, blob): of kind 1, the sums of the texts that have any."""
    shard, known, value = None, np.zeros(0, np.uint64), np.zeros(0, np.float32)
    for batch in batches:
        for i in range(len(batch)):
            at, kind, chunk = (batch.column(j)[i].as_py() for j in range(3))
            blob = memoryview(batch.column(3)[i].as_buffer())
            if at != shard:
                shard, known, value = at, np.zeros(0, np.uint64), np.zeros(0, np.float32)
            if kind == 0:
                n = len(blob) // 12
                known, value = np.frombuffer(blob[: 8 * n], np.uint64).copy(), np.frombuffer(blob[8 * n :], np.float32).copy()
                continue
            if kind == 1:
                n = int.from_bytes(blob[:8], "little")
                key = np.cumsum(_from_planes(blob[8 : 8 + 8 * n], np.uint64, n))
                if not len(known):
                    continue
                place = np.minimum(np.searchsorted(known, key >> np.uint64(16)), len(known) - 1)
                hit = np.flatnonzero(known[place] == key >> np.uint64(16))
                if not len(hit):
                    continue
                times = _from_planes(blob[8 + 8 * n :], np.uint32, n)
                text = (key[hit] & np.uint64(0xFFFF)).astype(np.int64)
                total = np.bincount(text, weights=value[place[hit]].astype(np.float64) * times[hit])
                some = np.flatnonzero(total)
                blob = some.astype(np.uint16).tobytes() + total[some].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), pa.array([bytes(blob)], pa.binary())], names=["chunk", "kind", "blob"])


def _summed(unknown: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by chunk, the texts first, to rows (k1, k2, lang, loss, n, pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = total = None

        def done() -> pa.RecordBatch:
            n = texts.column(3).to_numpy()
            return pa.RecordBatch.from_arrays([*texts.columns[:3], pa.array(-(total + unknown * n)), *texts.columns[3:]], names=["k1", "k2", "lang", "loss", "n", "pairs"])

        for batch in batches:
            for i in range(len(batch)):
                blob = batch.column(2)[i].as_buffer()
                if batch.column(1)[i].as_py() == 2:
                    if texts is not None:
                        yield done()
                    texts = pa.ipc.open_stream(blob).read_next_batch()
                    total = np.zeros(len(texts))
                else:
                    n = len(blob) // 10
                    np.add.at(total, np.frombuffer(blob, np.uint16, n), np.frombuffer(blob, np.float64, n, 2 * n))
        if texts is not None:
            yield done()

    return run


def with_losses(texts: DataFrame, model: DataFrame, unknown: float) -> DataFrame:
    """Rows (k1, k2, lang, loss, n, pairs) of texts, rows (k1, k2, lang, text): negative log-probability, number of words with
    the end mark, and number of different word pairs.

    The rows of one text key are equal. Texts are dealt to chunks in the order of their keys, so a partition that is computed
    again, after an executor was lost, deals the same chunks in whatever order its rows come.
    """
    spark = texts.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-model.count() // SHARD))
    entries = written(sharded(model, shards))

    def scored(wave: int) -> DataFrame:
        own = texts.where(F.pmod("k1", F.lit(WAVES)) == wave).sortWithinPartitions("k1", "k2", "lang")
        asked = own.mapInArrow(_requests(shards), _ROWS)
        met = spread(asked.unionByName(entries), "shard").sortWithinPartitions("shard", "kind").mapInArrow(_looked_up, "chunk long, kind int, blob binary")
        sums = spread(met, "chunk").sortWithinPartitions("chunk", F.desc("kind")).mapInArrow(_summed(unknown), "k1 long, k2 long, lang string, loss double, n long, pairs long")
        return written(sums.groupBy("k1", "k2", "lang").agg(*[F.min(x).alias(x) for x in ("loss", "n", "pairs")]))

    done = []
    for wave in range(WAVES):
        done.append(scored(wave))
    dropped(entries)
    out = done[0]
    for t in done[1:]:
        out = out.unionByName(t)
    return out


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trust_col: str = "quality") -> DataFrame | None:
    """Rows (k1, k2, lang, perplexity, score, highest, density, least, kept), one for each text and language; None if nothing can be judged.

    Trusted are the documents whose label is 1. Unless there are trusted texts both to count and to set thresholds, nothing
    can be judged. A language without trusted texts has the limits of all languages.
    """
    good = labels.where(F.col(trust_col) == 1).select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    text = text_column(text_col)
    k1, k2 = text_key(text)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), text.alias("text"), k1.alias("k1"), k2.alias("k2"))
    good = written(good)
    trusted = keyed.join(F.broadcast(good) if good.count() <= BROADCAST_IDS else good, "id", "left_semi")
    aside = F.pmod(F.shiftright("k1", 8), F.lit(100)) < HELD_OUT
    judges = written(trusted.where(aside).select("k1", "k2", "lang"))
    train = trusted.where(~aside)
    if judges.isEmpty() or train.isEmpty():
        return None
    model, unknown = trained(train)
    losses = written(with_losses(keyed.select("k1", "k2", "lang", "text"), model, unknown))
    dropped(model, good)
    own = written(judges.join(losses, ["k1", "k2", "lang"]).select("lang", "loss", "n", "pairs"))
    every = own.agg((F.sum("loss") / F.sum("n")).alias("mean")).first()["mean"]

    def figures(mean: Column) -> tuple[Column, Column]:
        score = (F.col("loss") + PRIOR * mean) / (F.col("n") + PRIOR)
        return score, F.greatest(score, mean) * (F.col("pairs") + PRIOR) / (F.col("n") + PRIOR)

    means = written(own.groupBy("lang").agg(((F.sum("loss") + PRIOR_MEAN * every) / (F.sum("n") + PRIOR_MEAN)).alias("mean"), F.count("*").alias("docs")))
    score, density = figures(F.col("mean"))
    apart = own.join(means, "lang").select("lang", (score - F.col("mean")).alias("score"), (density - F.col("mean")).alias("density"))
    quantiles = [F.percentile_approx("score", QUANTILE, ACCURACY).alias("high"), F.percentile_approx("density", 1 - QUANTILE, ACCURACY).alias("low")]
    of_all = apart.agg(*quantiles).first()
    share = F.col("docs") / (F.col("docs") + LANGUAGE_WEIGHT)
    limits = apart.groupBy("lang").agg(*quantiles).join(means, "lang")
    limits = written(limits.select("lang", "mean", *[(share * F.col(x) + (1 - share) * of_all[x]).alias(x) for x in ("low", "high")]))
    mean = F.coalesce("mean", F.lit(every))
    low, high = (mean + F.coalesce(x, F.lit(of_all[x])) for x in ("low", "high"))
    score, density = figures(mean)
    out = losses.join(limits, "lang", "left").select("k1", "k2", "lang", F.exp(F.col("loss") / F.col("n")).alias("perplexity"), score.alias("score"), (high + MARGIN).alias("highest"), density.alias("density"), (low * ENOUGH).alias("least"))
    return out.withColumn("kept", (F.col("score") <= F.col("highest")) & (F.col("density") >= F.col("least")))


FIGURES = ["perplexity", "score", "highest", "density", "least"]


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (doc_id, lang, perplexity, score, highest, density, least, kept), one for each row of docs.

    Kept are scores up to highest with densities from least. A null text counts as empty (one end mark), a null language as a language of its
    own, shown as null. Null and repeated ids and repeated rows are scored like any other; labels without a document, null
    labels and labels other than 1 are passed over, and an id with several labels is trusted if one is 1. If nothing can
    be judged, all are kept and the figures are null. Extra columns are ignored; an empty table gives no rows.
    """
    found = judged(docs, labels, id_col, text_col, lang_col)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("shown"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), *[k.alias(x) for k, x in zip(text_key(text_column(text_col)), ("k1", "k2"))])
    if found is None:
        return ids.select("doc_id", F.col("shown").alias("lang"), *[F.lit(None).cast("double").alias(x) for x in FIGURES], F.lit(True).alias("kept"))
    return ids.join(found, ["k1", "k2", "lang"]).select("doc_id", F.col("shown").alias("lang"), *FIGURES, "kept")


def trusted_like(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with their columns, whatever their names; all rows if nothing can be judged."""
    found = judged(docs, labels, id_col, text_col, lang_col)
    if found is None:
        return docs
    names = fresh(docs, 3)
    keys = [*text_key(text_column(text_col)), F.coalesce(F.col(lang_col).cast("string"), F.lit(""))]
    bad = written(found.where("NOT kept").select(*[F.col(c).alias(x) for c, x in zip(("k1", "k2", "lang"), names)]))
    return docs.withColumns(dict(zip(names, keys))).join(bad, names, "left_anti").select(*docs.columns)

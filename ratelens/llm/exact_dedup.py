"""Exact duplicates by progressive refinement: length, then the hash of a prefix, then the hash of the whole text.

Texts are equal when they are identical after lower-casing A-Z only, so their lengths in bytes are equal too. A first scan
counts rows by length and prefix hash; a second one hashes whole texts only where both are shared. Texts are never
shuffled: the second scan asks a bitmap of fixed size, and only narrow rows with a hash meet. All is built of DataFrame
functions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, heavy_join, text_column, written

#: Characters of the prefix that the second step hashes.
PREFIX = 64
#: Bits of the map of shared lengths and prefixes (a multiple of the 32768 of one row of it): 8 MB. A text of its own whose
#: bit is set by chance is hashed in vain, which changes no result.
MAP_BITS = 1 << 26
#: A key of more rows than one in HOT of all, and than LEAST_HOT, is joined where its rows lie (so at most HOT keys).
HOT, LEAST_HOT = 100_000, 10_000


def normalised(text: Column) -> Column:
    """Lower case for A-Z, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _steps(text: Column) -> tuple[Column, Column]:
    """What the first two steps compare: the length in bytes, and the hash of the normalised prefix."""
    return F.octet_length(text), F.xxhash64(normalised(F.substring(text, 1, PREFIX)))


def _bit(*step: Column) -> Column:
    return F.pmod(F.xxhash64(*step), F.lit(MAP_BITS))


def _bit_map(shared: DataFrame) -> DataFrame:
    """Rows (bucket, bits) with a bit for each shared length and prefix hash: at most MAP_BITS / 32768 rows of 4 KB."""
    place = shared.select(_bit(F.col("n"), F.col("p")).alias("bit"))
    return place.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: str | None = None) -> DataFrame:
    """One row for each row of docs: its key, keep_id (the largest key among the rows of an equal text), group_size (their
    number) and kept (whether the key is keep_id).

    digest names a further column: the SHA-256 of the normalised text in lowercase hex, of every row instead of those that
    the first two steps leave. A null text is an empty one. Null keys lose to all others; among nulls only, keep_id is null
    and all are kept. Rows that agree in key and text are told apart by nothing, so they are kept or dropped together. No
    rows give no rows; other columns of docs are not looked at, whatever their names. Texts of any length are hashed whole,
    where they lie.
    """
    body = text_column(text)
    length, prefix = _steps(body)
    pairs = docs.select(length.alias("n"), prefix.alias("p")).groupBy("n", "p").agg(F.count("*").alias("rows"))
    known = written(_bit_map(pairs.where("rows > 1")))

    place = _bit(length, prefix)
    rows = docs.select(F.col(key).alias("own_key"), body.alias("body"), F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at"))
    rows = rows.join(F.broadcast(known), "bucket", "left").withColumn("shared", _is_set(F.col("bits"), F.col("at")))
    whole = F.sha2(normalised(F.col("body")), 256)
    if digest is None:
        whole = F.when(F.col("shared"), whole)
    rows = rows.select("own_key", "shared", whole.alias("whole"))
    rows = written(rows.select("own_key", F.when(F.col("shared"), F.unhex("whole")).alias("hash"), *([F.col("whole")] if digest else [])))
    dropped(known)

    left = rows.where(F.col("hash").isNotNull())
    groups = written(left.groupBy("hash").agg(F.max("own_key").alias("keep_id"), F.count("*").alias("group_size")))
    hot = groups.where(F.col("group_size") > max(LEAST_HOT, rows.count() // HOT))
    several = heavy_join(left, groups, ["hash"], hot)
    single = rows.where(F.col("hash").isNull()).withColumns({"keep_id": F.col("own_key"), "group_size": F.lit(1).cast("long")})
    out = several.unionByName(single)
    return out.select(F.col("own_key").alias(key), "keep_id", "group_size", F.col("own_key").eqNullSafe(F.col("keep_id")).alias("kept"), *([F.col("whole").alias(digest)] if digest else []))


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose text another row keeps (see exact_groups for odd rows); all columns stay as they are."""
    lost = exact_groups(docs, key, text, digest="digest").where(~F.col("kept")).select(F.col(key).alias("lost_key"), "digest").distinct()
    same = docs[key].eqNullSafe(lost["lost_key"]) & (F.sha2(normalised(F.coalesce(docs[text].cast("string"), F.lit(""))), 256) == lost["digest"])
    return docs.join(lost, same, "left_anti")

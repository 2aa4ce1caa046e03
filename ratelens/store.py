"""A study on disk: numbered versions, of which each is claimed by one writer and names the tables it consists of.

A writer reads a version, writes the tables it changes to a folder of its own and then claims the next number by creating
its log file, which exists as a whole or not at all. Who comes second finds the number taken, and may apply its change to
the newer version instead; nothing that was written before a claim is ever read.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .shared import located

Study = dict[str, DataFrame]
#: Where a study's folder has its log and its tables.
LOG, DATA = "_versions", "tables"


class Conflict(RuntimeError):
    """Another writer has claimed the version."""


def versions(folder: str) -> list[int]:
    """The numbers of a study's versions, in a folder of any file system that Spark reads."""
    spark = SparkSession.active()
    where, system = located(spark, f"{folder}/{LOG}")
    found = system.listStatus(where) if system.exists(where) else []
    names = [s.getPath().getName() for s in found]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def entry(spark: SparkSession, folder: str, version: int) -> dict:
    """What the log says of a version: its parent, what made it, when, and where each table lies."""
    where, system = located(spark, f"{folder}/{LOG}/{version:06d}.json")
    stream = system.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def load(spark: SparkSession, folder: str, version: int | None = None) -> Study:
    """A version's tables, the newest one's by default."""
    found = versions(folder)
    if not found:
        raise FileNotFoundError(f"{folder} holds no study")
    out = {}
    for name, place in entry(spark, folder, found[-1] if version is None else version)["tables"].items():
        out[name] = spark.read.parquet(f"{folder}/{place}")
        out[name].stored_at = (str(folder), place)
    return out


def _claimed(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with its text, unless there is one; whether it did.

    A local file is linked to its name; elsewhere it is renamed, which HDFS refuses if there is one of the name. (Stores
    whose renames replace what is there don't keep two writers apart.)
    """
    where, system = located(spark, path)
    parent = where.getParent()
    system.mkdirs(parent)
    draft = spark._jvm.org.apache.hadoop.fs.Path(parent, f".{uuid.uuid4().hex}")
    if system.getScheme() == "file":
        own = draft.toUri().getPath()
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(own, where.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
    stream = system.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    done = not system.exists(where) and system.rename(draft, where)
    if not done:
        system.delete(draft, False)
    return done


def save(study: Study, folder: str, base: int | None = None, operation: str = "save") -> int:
    """Writes a study as the version after base (by default after the newest), and returns its number.

    Tables that were loaded from the folder and are still the same are named again instead of written. Raises Conflict if
    the version is taken. Whatever goes wrong, nothing readable is left behind.
    """
    spark = SparkSession.active()
    if base is None:
        base = (versions(folder) or [0])[-1]
    own = f"{DATA}/{base + 1:06d}-{uuid.uuid4().hex[:12]}"
    places = {}
    try:
        for name in S.TABLES:
            df = study[name]
            at, place = getattr(df, "stored_at", (None, None))
            if at == str(folder):
                places[name] = place
                continue
            columns = [(F.col(f.name) if f.name in df.columns else _missing(f.name)).cast(f.dataType).alias(f.name) for f in S.schema(name).fields]
            df.select(*columns).write.mode("errorifexists").parquet(f"{folder}/{own}/{name}")
            places[name] = f"{own}/{name}"
        about = {"version": base + 1, "parent": base or None, "operation": operation, "at": datetime.now(UTC).isoformat(), "tables": places}
        if not _claimed(spark, f"{folder}/{LOG}/{base + 1:06d}.json", json.dumps(about)):
            raise Conflict(f"version {base + 1} of {folder} has been written by someone else")
    except BaseException:
        where, system = located(spark, f"{folder}/{own}")
        system.delete(where, True)
        raise
    return base + 1


def update(spark: SparkSession, folder: str, change: Callable[[Study], Study], operation: str = "update", attempts: int = 10) -> int:
    """Applies a change to the newest version and commits it; if another writer was first, to the version that is newest
    then. A change that raises commits nothing, so what it checks holds for the version that it is committed on."""
    for left in reversed(range(attempts)):
        base = (versions(folder) or [0])[-1]
        study = change(load(spark, folder, base) if base else S.empty_study(spark))
        try:
            return save(study, folder, base, operation)
        except Conflict:
            if not left:
                raise


def history(spark: SparkSession, folder: str) -> DataFrame:
    """The log: rows (version, parent, operation, at, tables written)."""
    rows = []
    for n in versions(folder):
        e = entry(spark, folder, n)
        rows.append((n, e["parent"], e["operation"], e["at"], sorted(t for t, p in e["tables"].items() if p.startswith(f"{DATA}/{n:06d}-"))))
    return spark.createDataFrame(rows, "version int, parent int, operation string, at string, written array<string>")


def swept(spark: SparkSession, folder: str, older_than: float = 86_400) -> list[str]:
    """Deletes tables that no version names, such as a writer leaves that was killed; young ones may belong to one at work."""
    named = {p.split("/")[1] for n in versions(folder) for p in entry(spark, folder, n)["tables"].values()}
    where, system = located(spark, f"{folder}/{DATA}")
    gone = []
    for s in system.listStatus(where) if system.exists(where) else []:
        if s.getPath().getName() not in named and s.getModificationTime() / 1000 <= time.time() - older_than:
            system.delete(s.getPath(), True)
            gone.append(s.getPath().getName())
    return sorted(gone)


def _missing(name: str):
    return F.current_timestamp() if name == "created_at" else F.lit(None)

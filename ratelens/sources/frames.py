"""Frame images of clips, from a folder or a ZIP archive, and what there is of them without their images."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..schemas import CURVE_POINTS
from . import ranged

#: Where a member's name tells the clip (five digits) and the frame; a folder holds frames under their plain names.
MEMBER, FOLDER, FILE = r"(?:^|/)(\d{5})/(\d{1,2})\.jpe?g$", r"\d{5}", "{}.jpg"
#: Bytes of an archive that one task reads images of, and clip folders that one task lists.
PART_BYTES, PART_CLIPS = 32 << 20, 64


class _Part(InputPartition):
    """Members whose place in the archive is in a range, or clip folders."""

    def __init__(self, start: int = 0, end: int = 1 << 62, clips: tuple[str, ...] = ()):
        self.start, self.end, self.clips = start, end, clips


class FrameReader(DataSourceReader):
    """Conditions on clip and frame are taken over: what they rule out is neither opened nor read."""

    def __init__(self, options: dict):
        self.path, self.password = options["path"], options.get("password")
        self.images = options.get("images", "true").lower() == "true"
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.wanted: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "=", EqualNullSafe: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", IsNotNull: "any"}
        for f in filters:
            column = getattr(f, "attribute", ("",))
            if type(f) in kinds and column in (("clip_id",), ("frame_index",)) and getattr(f, "value", 0) is not None:
                self.wanted.append((column[0], kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def _fits(self, column: str, value: int) -> bool:
        holds = {"=": lambda w: value == w, ">": lambda w: value > w, ">=": lambda w: value >= w, "<": lambda w: value < w, "<=": lambda w: value <= w, "in": lambda w: value in w, "any": lambda w: True}
        return all(holds[kind](w) for c, kind, w in self.wanted if c == column)

    def _named(self) -> list[int] | None:
        """The clips that the conditions name, if they do."""
        sets = [{w} if kind == "=" else {*w} for c, kind, w in self.wanted if c == "clip_id" and kind in ("=", "in")]
        return sorted(c for c in set.intersection(*sets) if c is not None and self._fits("clip_id", c)) if sets else None

    def partitions(self) -> list[InputPartition]:
        found, named = ranged.info(self.path), self._named()
        if found.is_file:
            # Each task reads the archive's directory; a range of bytes stands for the members that begin in it.
            if not self.images or named is not None:
                return [_Part()]
            return [_Part(a, a + self.part_bytes) for a in range(0, max(1, found.size), self.part_bytes)]
        if named is not None:
            clips = [f"{c:05d}" for c in named if 0 <= c < 100_000]
        else:
            clips = [f.base_name for f in ranged.listed(self.path) if not f.is_file and re.fullmatch(FOLDER, f.base_name) and self._fits("clip_id", int(f.base_name))]
        return [_Part(clips=tuple(clips[i : i + PART_CLIPS])) for i in range(0, len(clips), PART_CLIPS)] or [_Part()]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from self._members(partition) if ranged.info(self.path).is_file else self._files(partition.clips)

    def _members(self, part: _Part) -> Iterator[tuple]:
        with ranged.opened(self.path) as source, zipfile.ZipFile(source) as archive:
            last: dict[tuple[int, int], zipfile.ZipInfo] = {}  # of several members of a frame, the last one counts
            for member in archive.infolist():
                if (match := re.search(MEMBER, member.filename, re.IGNORECASE)) and 1 <= int(match[2]) <= CURVE_POINTS:
                    last[int(match[1]), int(match[2])] = member
            mine = [(m.header_offset, clip, frame, m) for (clip, frame), m in last.items() if part.start <= m.header_offset < part.end and self._fits("clip_id", clip) and self._fits("frame_index", frame)]
            for _, clip, frame, member in sorted(mine, key=lambda x: x[:3]):
                row = (clip, frame, member.filename, member.file_size)
                yield (*row, archive.read(member, self.password.encode() if self.password else None)) if self.images else row

    def _files(self, clips: tuple[str, ...]) -> Iterator[tuple]:
        frames = {FILE.format(n): n for n in range(1, CURVE_POINTS + 1) if self._fits("frame_index", n)}
        for clip in clips:
            folder = f"{self.path.rstrip('/')}/{clip}"
            try:
                here = ranged.listed(folder)
            except FileNotFoundError:  # a clip that a condition names
                continue
            for f in here:
                if f.is_file and f.base_name in frames:
                    row = (int(clip), frames[f.base_name], f.path, f.size)
                    if self.images:
                        with ranged.opened(f"{folder}/{f.base_name}") as source:
                            row = (*row, source.read())
                    yield row


class Frames(DataSource):
    """Rows (clip_id, frame_index, path, size, content) of an archive or a folder; without content if images is false."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "clip_id int, frame_index int, path string, size bigint" + ", content binary" * (self.options.get("images", "true").lower() == "true")

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)


def frames(spark: SparkSession, path: str, password: str | None = None, images: bool = True, part_bytes: int = PART_BYTES) -> DataFrame:
    """The frames of a folder (clip folders with plain names) or a ZIP archive, in any file system that PyArrow opens.

    Executors open the source themselves and read ranges of it, so it must be one that they share. An archive's directory is
    held by each task that reads from it.
    """
    spark.dataSource.register(Frames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("frames").options(path=str(path), images=str(images).lower(), partBytes=part_bytes)
    # Spark keeps what a query pushed down for a next query on the same table that pushes nothing, so each pushes something.
    return (reader.option("password", password) if password else reader).load().where("clip_id IS NOT NULL")


def frame_index(spark: SparkSession, path: str, password: str | None = None) -> DataFrame:
    """Which frames a source holds, from its directory alone: no image is read."""
    return frames(spark, path, password, images=False)


def complete_clips(frames: DataFrame) -> DataFrame:
    """Clips that have all frames."""
    return frames.groupBy("clip_id").agg(F.count_distinct("frame_index").alias("n")).where(F.col("n") == CURVE_POINTS).select("clip_id")


def frame(frames: DataFrame, clip_id: int, frame_index: int) -> bytes:
    """One frame's bytes, the only image that is read; raises FileNotFoundError if there is none."""
    row = frames.where((F.col("clip_id") == clip_id) & (F.col("frame_index") == frame_index)).select("content").first()
    if row is None:
        raise FileNotFoundError(f"{clip_id:05d}/{frame_index}")
    return bytes(row.content)


def packed_zip(frames: list[tuple[str, bytes]]) -> bytes:
    """An archive of named files (a small result package, made on the driver)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in frames:
            archive.writestr(name, data)
    return out.getvalue()

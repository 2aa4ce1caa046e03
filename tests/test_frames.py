"""The frame source: what is read, what is pushed down, which member counts."""

import zipfile

import pytest

from ratelens.schemas import CURVE_POINTS
from ratelens.sources import frames, ranged

SIZE = 20_000


def image(clip, frame):
    return bytes([clip, frame]) * (SIZE // 2)


@pytest.fixture
def archive(tmp_path):
    """40 clips, one without its last frame; a frame with two members; names that are no frames."""
    path = tmp_path / "frames.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x/00003/1.jpg", b"an earlier one")
        for clip in range(1, 41):
            for n in range(1, CURVE_POINTS + 1 - (clip == 40)):
                z.writestr(f"x/{clip:05d}/{n:02d}.JPG" if clip % 2 else f"{clip:05d}/{n}.jpeg", image(clip, n))
        for name in ("readme.txt", "00001/17.jpg", "00001/0.jpg", "1/1.jpg", "00001/1.png"):
            z.writestr(name, b"no frame")
    return path


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "frames"
    for clip in (1, 2, 77):
        (path / f"{clip:05d}").mkdir(parents=True)
        for n in range(1, CURVE_POINTS + 1 - (clip == 2)):
            (path / f"{clip:05d}" / f"{n}.jpg").write_bytes(image(clip, n))
    for name in ("00001/1.JPG", "00001/01.jpg", "00002/16.png", "123/1.jpg"):
        (path / name).parent.mkdir(exist_ok=True)
        (path / name).write_bytes(b"other")
    return path


@pytest.fixture
def counted(monkeypatch):
    """Counts the bytes read from files."""
    total = []

    class Counting:
        def __init__(self, file):
            self.file = file

        def read(self, n=-1):
            data = self.file.read() if n is None or n < 0 else self.file.read(n)
            total.append(len(data))
            return data

        def __getattr__(self, name):
            return getattr(self.file, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    monkeypatch.setattr(ranged, "opened", lambda path, own=ranged.opened: Counting(own(path)))
    return total


def rows(reader):
    return [r for p in reader.partitions() for r in reader.read(p)]


def pushed(path, filters=(), **options):
    reader = frames.FrameReader({"path": str(path)} | options)
    assert list(reader.pushFilters(list(filters))) == []
    return reader


def test_one_frame_is_read_alone(archive, counted):
    got = rows(pushed(archive, [frames.EqualTo(("clip_id",), 7), frames.EqualTo(("frame_index",), 9)]))
    assert [(r[0], r[1], r[4]) for r in got] == [(7, 9, image(7, 9))]
    assert SIZE < sum(counted) < SIZE + 100 * 41 * 17  # the directory and the member


def test_an_index_reads_no_image(archive, folder, counted):
    assert len(rows(pushed(archive, images="false"))) == 40 * 16 - 1 and sum(counted) < 100 * 41 * 17 + 70_000
    before = sum(counted)
    assert len(rows(pushed(folder, images="false"))) == 47 and sum(counted) == before


def test_parts_by_bytes_share_the_members(archive):
    reader = pushed(archive, partbytes=str(10 * SIZE))
    parts = [list(reader.read(p)) for p in reader.partitions()]
    assert len(parts) > 60 and max(map(len, parts)) <= 11
    assert sorted((r[0], r[1]) for p in parts for r in p) == sorted((c, n) for c in range(1, 41) for n in range(1, 17) if (c, n) != (40, 16))


def test_the_last_member_of_a_frame_counts(archive):
    assert rows(pushed(archive, [frames.EqualTo(("clip_id",), 3), frames.In(("frame_index",), (1,))]))[0][4] == image(3, 1)


def test_conditions(archive, folder):
    f = frames
    for path, clips in ((archive, range(1, 41)), (folder, (1, 2, 77))):
        last = {(40, 16), (2, 16)} if path == folder else {(40, 16)}
        every = {(c, n) for c in clips for n in range(1, 17)} - last
        for filters, holds in [
            ([f.In(("clip_id",), (2, 77, 999, None))], lambda c, n: c in (2, 77)),
            ([f.GreaterThan(("clip_id",), 1), f.LessThanOrEqual(("frame_index",), 3)], lambda c, n: c > 1 and n <= 3),
            ([f.GreaterThanOrEqual(("frame_index",), 15), f.LessThan(("clip_id",), 3), f.IsNotNull(("clip_id",))], lambda c, n: n >= 15 and c < 3),
            ([f.EqualNullSafe(("clip_id",), 2), f.EqualTo(("clip_id",), 1)], lambda c, n: False),
            ([f.EqualTo(("clip_id",), -1)], lambda c, n: False),
        ]:
            assert {(r[0], r[1]) for r in rows(pushed(path, filters))} == {x for x in every if holds(*x)}
    reader = f.FrameReader({"path": str(archive)})
    other = [f.EqualTo(("path",), "x"), f.StringContains(("path",), "x") if hasattr(f, "StringContains") else f.EqualTo(("size",), 1), f.EqualNullSafe(("clip_id",), None)]
    assert list(reader.pushFilters(other)) == other


@pytest.mark.parametrize("source", ["archive", "folder"])
def test_queries(spark, source, request):
    path = request.getfixturevalue(source)
    every = frames.frames(spark, str(path))
    whole = {r.clip_id for r in frames.complete_clips(frames.frame_index(spark, f"file://{path}")).collect()}
    assert whole == ({*range(1, 40)} if source == "archive" else {1, 77})
    assert frames.frame(every, 1, 16) == image(1, 16)
    with pytest.raises(FileNotFoundError):
        frames.frame(every, 2 if source == "folder" else 40, 16)
    plan = every.where("clip_id = 1 AND frame_index IN (1, 2)")._jdf.queryExecution().toString()
    assert "Filter (" not in plan.split("== Physical Plan ==")[1] and every.where("clip_id = 1 AND frame_index IN (1, 2)").count() == 2
    assert every.where("clip_id < 3 AND path LIKE '%/5%' OR frame_index = 99").count() == (1 if source == "archive" else 2)


def test_a_missing_source(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFoundError"):
        frames.frame_index(spark, str(tmp_path / "gone")).count()

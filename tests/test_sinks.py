"""Named files that tasks write together, workbooks, and what a release scan finds."""

import csv
import gzip
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ratelens.sources import files, workbook


def test_one_file_in_order(spark, tmp_path):
    path = tmp_path / "deep" / "out.csv"
    df = spark.range(5000).select(F.col("id"), F.concat(F.lit('a "q", '), "id").alias("t"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.col("id").cast("double"))).alias("v"), F.when(F.col("id") > 1, F.lit("line\nbreak")).alias("n")).repartition(7)
    files.write_csv(df, path, ["t", "id", "v", "n"], [F.desc("id")], mark=True, digest=tmp_path / "digest.json")
    data = path.read_bytes()
    assert data.startswith(b"\xef\xbb\xbft,id,v,n\n") and [p.name for p in path.parent.iterdir()] == ["out.csv"]
    rows = list(csv.reader(io.StringIO(data.decode("utf-8-sig"))))
    assert [int(r[1]) for r in rows[1:]] == list(range(4999, -1, -1))
    assert rows[1] == ['a "q", 4999', "4999", "", "line\nbreak"] and rows[2][2] == "[1.0,4998.0]" and rows[-1][3] == ""
    about = json.loads((tmp_path / "digest.json").read_text())
    assert about == {"rows": 5000, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    files.write_csv(df.limit(2), path, ["id"], ["id"])  # replaces
    assert len(path.read_text().splitlines()) == 3


def test_gzip_numbers_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, None), (2, None, 0.1)], "a int, b double, c double")
    files.write_csv(df, tmp_path / "x.csv.gz", order=["a"], compression="gzip", nan_text="nan")
    assert gzip.decompress((tmp_path / "x.csv.gz").read_bytes()) == b"a,b,c\n1,2.5,nan\n2,nan,0.1\n"
    files.write_csv(df.limit(0), f"file://{tmp_path}/none.csv", order=["a"], mark=True)
    assert (tmp_path / "none.csv").read_bytes() == b"\xef\xbb\xbfa,b,c\n"


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = tmp_path / "out.csv"
    files.write_csv(spark.range(3), path, order=["id"])
    with pytest.raises(Exception, match="no more"):
        files.write_csv(spark.range(100).repartition(5).withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("no more"))).otherwise("y")), path)
    assert path.read_text() == "id\n0\n1\n2\n" and [p.name for p in tmp_path.iterdir()] == ["out.csv"]


def test_what_is_written_is_read_back(spark, tmp_path):
    files.write_csv(spark.createDataFrame([(1, "a,b"), (2, None)], "n int, t string"), tmp_path / "x.csv", order=["n"], mark=True)
    assert [tuple(r) for r in files.csv(spark, tmp_path / "x.csv", "n int, t string", ("n", "t")).orderBy("n").collect()] == [(1, "a,b"), (2, None)]
    (tmp_path / "y.csv").write_text(" label , video_name\n3,5\n")
    assert files.csv(spark, tmp_path / "y.csv", "video_name int, label int", ("video_name", "label")).first() == (3, 5)


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path, sheets, shared=()):
    """A workbook of sheets by name, each the XML of its rows."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i == 2 else ""}worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
    return path


def numbers(rows):
    return "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}"><v>{v}</v></c>' for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows, 1))


def test_cells_of_a_workbook(spark, tmp_path):
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t><rPh><t>no</t></rPh></is></c></row>'
    rows += '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>2.5</v></c><c r="C2" t="b"><v>1</v></c><c r="AB2"><v>9</v></c></row><row r="3"/>'
    rows += '<row r="5"><c r="B5" t="e"><v>#N/A</v></c><c r="C5" t="str"><v>f</v></c></row>'
    path = book(tmp_path / "b.xlsx", {"first": numbers([[1]]), "second": rows}, ["<t> name </t>", "<r><t>rich </t></r><r><t>text</t></r>"])
    df = workbook.workbook(spark, path, "second")
    assert df.columns == ["line", "name", "column_1", "x"]
    assert [tuple(r) for r in df.orderBy("line").collect()] == [(1, "rich text", "2.5", "1"), (3, None, None, "f")]
    assert workbook.workbook(spark, path, 0).columns == ["line", "1"] and workbook.workbook(spark, path, 1).count() == 2
    with pytest.raises(Exception, match="not third"):
        workbook.workbook(spark, path, "third").count()
    assert [workbook.column_number(x) for x in ("A1", "Z9", "AA1", "BC12")] == [0, 25, 26, 54]


def test_votes_of_a_workbook_are_taken_by_position(spark, tmp_path):
    names = ["one", "two", "three", "four", "five", "six", "seven", "order", "label"]
    head = '<row r="1">' + "".join(f'<c r="{chr(65 + i)}1" t="s"><v>{i}</v></c>' for i in range(9)) + "</row>"
    body = numbers([[None]] + [[8, 2, 0, 0, 0, 0, 0, n, n % 7 + 1] for n in range(1, 4001)]).replace('<row r="1"></row>', "")
    path = book(tmp_path / "votes.xlsx", {"s": head + body}, [f"<t>{n}</t>" for n in names])
    got = files.votes(spark, path)
    assert got.columns == [*files.VOTE_COLUMNS, "order", "label"] and got.count() == 4000
    assert tuple(got.where("`order` = 4000").first()) == (8, 2, 0, 0, 0, 0, 0, 4000, 4000 % 7 + 1)
    with pytest.raises(ValueError, match="order"):
        files.votes(spark, book(tmp_path / "short.xlsx", {"s": head}, [f"<t>{n}</t>" for n in names[:7] + ["other", "label"]]))


def test_release_scan(spark, tmp_path):
    texts = {
        "a.py": "x = 1\nroot = '/Volumes/Lenovo/data'\n", "docs/b c.md": "\n" * 7 + "see server_backup there, server_backup", "ok.txt": "nothing", "data.csv": "server_backup",
        "conf.toml": 'frames_archive_password = ""\nframes_archive_password="x"', "project.toml": 'frames_archive_password="x"', "local_data/z.py": "server_backup", "x/.git/z.md": "server_backup", "._r.md": "server_backup",
    }
    for name in ("m.PTH", "w.npz", "v/clip.mp4", "demo_data/z.zip", "demo_data/1.jpg", "pic.JPG", "exports/1.zip", ".db"):
        texts[name] = "x"
    big = "".join(f"line {i}\n" for i in range(300_000))
    texts["big.txt"] = big + "server_backup\n" + big
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700000")
    try:
        found = sorted((r.check, r.path, r.line) for r in files.release_findings(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == sorted([
        ("forbidden binary", "m.PTH", None), ("forbidden binary", "w.npz", None), ("forbidden binary", "v/clip.mp4", None), ("forbidden binary", "demo_data/z.zip", None), ("image outside demo", "pic.JPG", None),
        ("sensitive text", "a.py", 2), ("sensitive text", "docs/b c.md", 8), ("sensitive text", "conf.toml", 2), ("sensitive text", "big.txt", 300_001),
    ], key=lambda r: r[:2])

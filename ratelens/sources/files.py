"""File sources and sinks of a study: splits, votes, manifests, bundles, CSV and JSON outputs."""

from __future__ import annotations

import json
import tomllib
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators.integrity import in_domain, in_range
from . import ranged
from .sinks import write_csv, write_text
from .workbook import workbook

#: The vote columns of the clarity table, in class order.
VOTE_COLUMNS = ["1happy", "2sad", "3neutral", "4angry", "5surprise", "6disgust", "7fear"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), line: str | None = None) -> DataFrame:
    """A CSV file with a header, read by name into the given schema; missing required columns raise.

    line names a further column that rises with the rows of the file; times may have either form that studies hold.
    """
    path = str(path)
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    names = {c: c.strip() for c in raw.columns}
    if lost := set(required) - set(names.values()):
        raise ValueError(f"{path} lacks the columns {sorted(lost)}")
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    kind = lambda c: kinds.get(names[c], T.StringType())
    value = lambda c: C.stamp(F.col(f"`{c}`")) if kind(c) == T.TimestampType() else F.col(f"`{c}`").cast(kind(c))
    order = [F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias(line)] if line else []
    return raw.select(*[value(c).alias(names[c]) for c in raw.columns], *order)


def load_split(rows: DataFrame, ordinal: str = "line") -> DataFrame:
    """Clips of a split: label 1 to 7, the first row of each clip in the order of the ordinal column, with emotions."""
    own = rows.select(F.col("video_name").cast("int").alias("clip_id"), F.col("label").cast("int").alias("label"), ordinal)
    own = own.where(F.col("label").between(1, 7)).withColumn("_n", F.row_number().over(Window.partitionBy("clip_id").orderBy(ordinal))).where("_n = 1")
    return own.select("clip_id", "label", C.emotion(F.col("label")).alias("emotion"))


def votes(spark: SparkSession, path: str) -> DataFrame:
    """A vote table, a workbook's first sheet or a CSV file, whose first seven columns are the votes, with order and label."""
    if str(path).lower().endswith((".xlsx", ".xlsm")):
        rows = workbook(spark, path).drop("line")
        if lost := {"order"} - set(rows.columns):
            raise ValueError(f"{path} lacks the columns {sorted(lost)}")
        return votes_by_position(rows.withColumns({c: F.col(c).try_cast("double").cast("int") for c in ("order", "label") if c in rows.columns}))
    return votes_by_position(csv(spark, path, "order int, label int", ("order",)))


def votes_by_position(rows: DataFrame) -> DataFrame:
    """A vote table whose first seven columns are the votes in class order, whatever their names."""
    if len(rows.columns) < len(VOTE_COLUMNS):
        raise ValueError("a vote table has at least seven columns")
    rest = [c for c in rows.columns[len(VOTE_COLUMNS) :] if c not in VOTE_COLUMNS]
    return rows.select(*[F.col(f"`{c}`").try_cast("double").cast("int").alias(v) for c, v in zip(rows.columns, VOTE_COLUMNS)], *rest)


def stimulus_audit(stimulus: DataFrame, clips: DataFrame) -> DataFrame:
    """Rows (check, subject): study clips without stimulus features, and clips with several rows.

    Both tables are dealt by clip over the session's number of partitions and counted there at once: long sorted keys
    compress so well that partitions merged by their bytes would hold many more rows than one task has memory for.
    """
    rows = clips.select("clip_id", F.lit(True).alias("_study")).unionAll(stimulus.select("clip_id", F.lit(False)))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "clip_id")
    per = rows.groupBy("clip_id").agg(F.count_if(F.col("_study")).alias("_clips"), F.count_if(~F.col("_study")).alias("_rows"))
    lost = (F.col("_clips") > 0) & ((F.col("_rows") == 0) | F.col("clip_id").isNull())  # what has no id has no features
    checks = F.array_compact(F.array(F.when(lost, "missing"), F.when(F.col("_rows") > 1, "duplicate")))
    return per.select(F.explode(checks).alias("check"), F.col("clip_id").alias("subject"))


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """What is wrong with a calibration manifest (clip_id, task_type, frame_index)."""
    frames = manifest.where("task_type = 'frame'")
    lost = frames.where("frame_index IS NULL").select(F.lit("frame_index").alias("check"), F.col("clip_id").cast("string").alias("subject"), F.lit(None).cast("string").alias("detail"))
    return in_domain(manifest, "task_type", "clip_id", "task_type", ["frame", "clip"]).unionAll(in_range(frames, "frame_index", "clip_id", "frame_index", 1, 16)).unionAll(lost)


def load_config(path: str | Path) -> dict:
    """A TOML configuration, with the folder that its paths are relative to under _folder."""
    with open(path, "rb") as f:
        return tomllib.load(f) | {"_folder": str(Path(path).resolve().parent)}


def resolve(config: dict, value: str, root: str | Path = ".") -> Path:
    """A path of the configuration: absolute, else beside the configuration if it exists there, else under the root."""
    path = Path(value)
    if path.is_absolute():
        return path
    beside = Path(config["_folder"]) / path
    return beside if beside.exists() else Path(root) / path


def _bundled(rows: DataFrame) -> DataFrame:
    """A bundle's table with its curves as lists of numbers, under either name that bundles give them."""
    named = [c for c in ("intensities_json", "intensities") if c in rows.columns]
    return rows.withColumn("intensities", F.from_json(named[0], "array<double>")).drop("intensities_json") if named else rows


def bundle_folders(spark: SparkSession, folders: list[str], schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of export folders with their bundle ids; a folder describes itself in bundle.json or manifest.json."""
    out: dict[str, DataFrame] = {}
    for number, folder in enumerate(map(str, folders)):
        found = [name for name in ("bundle.json", "manifest.json") if exists(spark, f"{folder}/{name}")]
        if not found:
            raise FileNotFoundError(f"{folder} holds neither bundle.json nor manifest.json")
        about = spark.read.option("multiLine", True).schema("bundle_id string, annotator string, design_version string, exported_at string, completed_assignments int").json(f"{folder}/{found[0]}")
        about = about.withColumns({"source_path": F.lit(folder), "number": F.lit(number)})
        tables = {"bundle": about} | {t: _bundled(csv(spark, f"{folder}/{t}.csv", s)).crossJoin(F.broadcast(about.select("bundle_id"))) for t, s in schemas.items()}  # one row
        out = {k: out[k].unionByName(v) if k in out else v for k, v in tables.items()}
    return out


def package(spark: SparkSession, about: dict[str, object], tables: dict[str, tuple[DataFrame, list[str], str]], folder: str) -> dict[str, str]:
    """A rater's results: a CSV with a byte order mark for each table, manifest.json with the digest of each, and all of them
    in an archive beside the folder.

    tables: by name, the rows, the columns to write and the column to sort by. Returns the digests, which are made as the
    files are. The archive is packed on the driver, a file after another.
    """
    found = {}
    for name, (df, columns, order) in tables.items():
        write_csv(df, f"{folder}/{name}.csv", columns, [order, columns[0]], mark=True, digest=f"{folder}/{name}.digest")
        system, place = ranged.system_of(f"{folder}/{name}.digest")
        with system.open_input_stream(place) as source:
            found[f"{name}.csv"] = json.loads(source.read())["sha256"]
        system.delete_file(place)
    write_text(f"{folder}/manifest.json", json.dumps(about | {"files": found}, ensure_ascii=False, indent=2))
    system, place = ranged.system_of(str(folder).rstrip("/") + ".zip")
    with system.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in [*found, "manifest.json"]:
            with ranged.opened(f"{folder}/{name}") as source, archive.open(name, "w") as member:
                while data := source.read(1 << 22):
                    member.write(data)
    return found


def bundle_json(about: DataFrame) -> DataFrame:
    """The description of an export as JSON text."""
    return about.select(F.to_json(F.struct(*about.columns)).alias("value"))


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (path, size, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def snapshot(study: dict[str, DataFrame], folder: str) -> None:
    """A backup of all tables as Parquet; the folder must be new."""
    for name, df in study.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def restored(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


#: What a release scan passes over, and what it reports by name or by line.
SKIPPED_FOLDERS = [".git", ".venv", ".sites-runtime", "local_data", "exports", "backups", "artifacts", "__pycache__"]
SKIPPED_FILES, DEMO_FOLDER = ["project.toml"], "demo_data"
FORBIDDEN = [".pth", ".pt", ".npy", ".npz", ".sqlite", ".db", ".zip", ".mp4", ".avi"]
IMAGES = [".jpg", ".jpeg", ".png"]
TEXTS = [".py", ".md", ".toml", ".txt", ".html", ".css", ".js", ".bat", ".command"]
SENSITIVE = [r"/Volumes/Lenovo/", r"server_backup", r'frames_archive_password\s*=\s*"[^"]+"']


def scanned(paths: Column) -> tuple[Column, Column]:
    """Whether a release scan looks at a file (by its path within the scanned folder), and its suffix in lower case."""
    parts = F.split(paths, "/")
    name = F.element_at(parts, -1)
    skipped = F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS))) | name.startswith("._") | name.isin(SKIPPED_FILES)
    return ~skipped, F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def named_findings(files: DataFrame) -> DataFrame:
    """Files (path) that must not be published whatever they hold: rows (check, path, line, detail)."""
    looked, suffix = scanned(F.col("path"))
    demo = F.array_contains(F.split("path", "/"), DEMO_FOLDER)
    check = F.when(suffix.isin(FORBIDDEN), "forbidden binary").when(suffix.isin(IMAGES) & ~demo, "image outside demo")
    return files.where(looked).select(check.alias("check"), "path", F.lit(None).cast("long").alias("line"), suffix.alias("detail")).where("check IS NOT NULL")


def line_findings(lines: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Lines (path, line, text) of text files that hold what must not be published: rows (check, path, line, detail)."""
    looked, suffix = scanned(F.col("path"))
    rules = F.array(*[F.when(F.col("text").rlike(p), F.lit(p)) for p in patterns or SENSITIVE])
    rows = lines.where(looked & suffix.isin(TEXTS)).withColumn("detail", F.explode(F.array_compact(rules)))
    return rows.select(F.lit("sensitive text").alias("check"), "path", "line", "detail")


def folder_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a folder's text files: rows (path within the folder, line from 1, text).

    Large files are read in splits. A split's lines are counted apart, so that a line's number is its place in the split
    and the lines of the splits before.
    """
    globs = "*.{" + ",".join(s[1:] for s in TEXTS) + "}"
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", globs).text(folder)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    sizes = raw.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")  # over splits, not over lines
    rows = raw.join(sizes.withColumn("before", before), ["file", "split"])
    return rows.select(_within(spark, F.col("file"), folder, encoded=True).alias("path"), (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "text")


def _within(spark: SparkSession, path: Column, folder: str, encoded: bool = False) -> Column:
    """A file's path relative to a folder that it lies in; file metadata has it encoded as in a URI."""
    where = spark._jvm.org.apache.hadoop.fs.Path(str(folder))
    whole = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toUri().getPath().rstrip("/")
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    if encoded:
        plain = F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))
    return F.substring(plain, len(whole) + 2, 1 << 30)


def release_findings(spark: SparkSession, folder: str) -> DataFrame:
    """What must not be published of a folder: rows (check, path, line, detail). No file but texts is read, and no file
    need fit in memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(_within(spark, F.col("path"), folder).alias("path"))
    return named_findings(files).unionAll(line_findings(folder_lines(spark, folder)))

"""Reading directories, tables and texts; writing one output for one input."""

from __future__ import annotations

import os
import posixpath
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_hidden, is_system_file, route


def scan(spark: SparkSession, root: str, recursive: bool = True, skip_hidden: bool = True, content: bool = True) -> DataFrame:
    """(path relative to root, file, length, modified, [content], kind) of all
    files but system and hidden ones, or of the one file `root`, whose path is its
    name. Without `content` no bytes are read. Empty files are listed too."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    one = fs.exists(p) and not fs.getFileStatus(p).isDirectory()
    local = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    prefix = (os.path.dirname(root) if one else root).rstrip("/").removeprefix("file://") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    rows = files.select(local(F.col("path")).alias("file"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    # The reader passes over empty files; the index that it lists them from, which the driver holds anyway, doesn't.
    listed = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "file string").select(local(F.col("file")).alias("file"))
    empty = listed.join(rows.select("file"), "file", "left_anti").select("file", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"), *([F.lit(b"").alias("content")] if content else []))
    out = rows.unionByName(empty)
    out = out.withColumn("path", F.substring("file", F.lit(len(prefix) + 1), F.length("file"))).select("path", "file", "length", "modified", *(["content"] if content else []))
    out = out.where(~is_system_file(F.col("path")))
    if skip_hidden:
        out = out.where(~is_hidden(F.col("path")))
    return out.withColumn("kind", route(F.col("path"), F.col("content") if content else None))


def listing(spark: SparkSession, root: str, **settings) -> DataFrame:
    """scan() without contents, by path."""
    return scan(spark, root, content=False, **settings).orderBy("path")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns strings, quoted newlines kept, empty fields ''."""
    df = spark.read.options(header=True, multiLine=True, escape='"', inferSchema=False, emptyValue="", nullValue="\u0000", mode="PERMISSIVE").csv(path)
    return df.fillna("")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, is_valid) of whole files; bytes that are no UTF-8 are told."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.expr("try_validate_utf8(content)").alias("text"), F.expr("is_valid_utf8(content)").alias("is_valid"))


def preview(text, n: int = 1000):
    return F.substring(text, 1, n)


MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff"}


def image_preview(path, content):
    """An image as a data URL, its kind told by the extension, by default PNG."""
    kinds = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    kind = F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract(path, r"[.]([^.]*)$", 1))), F.lit("image/png"))
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def probe(files: DataFrame) -> DataFrame:
    """What files (scan()) are, without their being processed: path, kind, length,
    whether they are supported, and for DICOM files frames, size, colour, modality."""
    shape = "struct<frames:int,rows:int,columns:int,is_color:boolean,modality:string,error:string>"

    @F.pandas_udf(shape)
    def look(content: pd.Series) -> pd.DataFrame:
        from .pixels import read_dicom

        rows = []
        for c in content:
            try:
                d = read_dicom(bytes(c))
                t = d.tags()
                rows.append((int(t.get("NumberOfFrames") or 1), int(t["Rows"]), int(t["Columns"]), int(t.get("SamplesPerPixel") or 1) >= 3, t.get("Modality"), None))
            except Exception as e:
                rows.append((None, None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["frames", "rows", "columns", "is_color", "modality", "error"]).astype({"frames": "Int32", "rows": "Int32", "columns": "Int32", "is_color": "boolean"})

    seen = files.where(F.col("kind") == "dicom").select("path", look("content").alias("d"))
    out = files.select("path", "kind", "length", F.col("kind").isNotNull().alias("supported")).join(seen, "path", "left")
    video = F.when(F.col("kind") == "video", True).otherwise(F.coalesce(F.col("d.frames") > 1, F.lit(False)))
    return out.select("path", "kind", "length", "supported", video.alias("is_video"), "d.frames", "d.rows", "d.columns", "d.is_color", "d.modality", F.col("d.error").alias("error"))


def sidecars(results: DataFrame) -> DataFrame:
    """(path, content) of an audit file beside every output: its result row as
    JSON, named <stem>_debug.json."""
    to = F.concat(F.regexp_replace("to", r"[.][^./]*$", ""), F.lit("_debug.json"))
    return results.where("to is not null").select(to.alias("path"), F.to_json(F.struct(*[c for c in results.columns if c != "to"])).cast("binary").alias("content"))


def read_table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state or mapping table; an empty one where there is none yet. Files of it
    that are no tables are passed over."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_each(outputs: DataFrame, root: str) -> DataFrame:
    """Writes (path, content) rows as files under `root`, each by a rename, so a
    repeated task leaves the same file; one result row each. Paths that leave
    `root` are refused. `root` is a folder of a file system that pyarrow knows
    (file, hdfs, s3, gs), shared by the executors."""
    if "://" in root:
        base = root.rstrip("/")
    else:
        base = os.path.abspath(root.removeprefix("file:"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = pafs.FileSystem.from_uri(base) if "://" in base else (pafs.LocalFileSystem(), base)
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                try:
                    to = posixpath.normpath(posixpath.join(top, r.path))
                    if not to.startswith(top.rstrip("/") + "/"):
                        raise ValueError("path outside the output directory")
                    fs.create_dir(posixpath.dirname(to), recursive=True)
                    part = f"{to}.part-{os.getpid()}"
                    with fs.open_output_stream(part) as out:
                        out.write(bytes(r.content))
                    fs.move(part, to)
                    rows.append((r.path, to, True, None))
                except (OSError, ValueError) as e:
                    rows.append((r.path, None, False, str(e)))
            yield pd.DataFrame(rows, columns=["input_path", "output_path", "success", "error"])

    return outputs.select("path", "content").mapInPandas(run, "input_path string, output_path string, success boolean, error string")


def zip_outputs(root: str, to: str) -> int:
    """All files under `root` in one archive, after a job; their number."""
    names = sorted(p for p in Path(root).rglob("*") if p.is_file())
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in names:
            z.write(p, p.relative_to(root))
    return len(names)


FOLDER_CSV, FILE_CSV = "folder_anonymization.csv", "filename_anonymization.csv"


def read_mappings(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(folder, alias) and (to_folder, name, alias) of the mapping files under an
    output directory, wherever they lie; empty where there are none."""

    def csvs(pattern: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).options(header=True, multiLine=True, escape='"', recursiveFileLookup=True, pathGlobFilter=pattern).csv(out)
        except AnalysisException:
            return spark.createDataFrame([], schema).withColumn("_metadata", F.struct(F.lit("").alias("file_path")))

    folders = csvs(FOLDER_CSV, "original_foldername string, anonymized_foldername string, phi_values string, phi_categories string")
    folders = folders.where("original_foldername <> '' and anonymized_foldername <> ''").select(F.col("original_foldername").alias("folder"), F.col("anonymized_foldername").alias("alias"))
    files = csvs(FILE_CSV, "original_filename string, anonymized_filename string, phi_values string, phi_categories string")
    prefix = out.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/")
    folder = F.regexp_replace(F.substring(path, F.lit(len(prefix) + 2), F.length(path)), rf"/?{FILE_CSV.replace('.', '[.]')}$", "")
    files = files.select(F.url_decode(folder).alias("to_folder"), F.col("original_filename").alias("name"), F.col("anonymized_filename").alias("alias")).where("name <> '' and alias <> ''")
    return folders.dropDuplicates(["folder"]), files.dropDuplicates(["to_folder", "name"])

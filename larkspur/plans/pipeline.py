"""A directory of mixed files de-identified as one plan.

All supported files become units of text (a document, a paragraph, a cell, a
tag, a transcript) in one table, so dates, masks and redactions are expressions
over it, whatever the files were. Files are put together again one by one, each
by its path, and their pixels are redacted there; a file's bytes travel once.
What has no backend here is reported as failed, and nothing of it is written.
"""

from __future__ import annotations

import csv
import io
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import base_name, is_open, mask, redact_literals, stem
from ..operators import dicom, media, paths, state
from ..operators.detectors import Detector, RuleDetector, detect
from ..operators.documents import chunks
from ..operators.media import Backends
from ..sources import files, office
from ..sources.pixels import read_dicom
from ..sources.shared import Versions, durable, spread

#: Kinds whose old bytes are needed to put the new file together.
WHOLE = ("excel", "docx", "dicom", "image", "pdf", "video")
TAG, PIXELS, SPEECH = "tag", "pixels", "transcript"
UNITS = "path string, part string, row long, col int, column string, value string, error string"
#: Units, and bytes of the files they came from, that go to Spark at once.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
FOLDERS = "folder string, base string, counter int, alias string"
FILES = "folder string, name string, base string, counter int, alias string"
IDENTIFIER = r"(?i)(^|_)(id|mrn|ssn|name|phone|email|address)$"


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])


def _units_of(path: str, kind: str, data: bytes, b: Backends) -> list[tuple]:
    if kind == "text":
        return [(path, "text", 0, 0, None, data.decode("utf-8"), None)]
    if kind == "docx":
        return [(path, part, i, 0, None, t, None) for part, i, t in office.read_docx(data)]
    if kind == "audio":
        return [(path, SPEECH, 0, 0, None, media.transcript(data, b), None)]
    if kind in ("image", "pdf", "video"):
        b.need("ocr")
        return [(path, PIXELS, -1, 0, None, None, None)]
    if kind == "dicom":
        b.need("ocr")
        return [(path, PIXELS, -1, 0, None, None, None)] + [(path, TAG, i, 0, k, v, None) for i, (k, v) in enumerate(read_dicom(data).tags().items())]
    if kind not in ("csv", "excel"):
        raise NotImplementedError(f"no backend for {kind or 'this kind of file'}")
    if kind == "csv":
        rows = list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))
        sheets = {"": (rows[0], rows[1:])} if rows else {"": ([], [])}
    else:
        sheets = office.read_xlsx(data)
    out = []
    for name, (header, body) in sheets.items():
        out += [(path, name, -1, k, h, h, None) for k, h in enumerate(header)]
        out += [(path, name, i, k, h, r[k] if k < len(r) else "", None) for i, r in enumerate(body) for k, h in enumerate(header)]
    return out


def units(todo: DataFrame, backends: Backends | None = None) -> DataFrame:
    """Units of files (path, kind, content). Row -1 of a table is its header, and
    stands for pixels elsewhere. A file that can't be read gives one row with its
    error."""
    b = backends or Backends()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0  # of as many files as make a batch: one a file would cost more than its units
        for f in batches:
            for path, kind, content in zip(*f.columns):
                path, data = path.as_py(), content.as_py()
                try:
                    rows += _units_of(path, kind.as_py(), bytes(data), b)
                except Exception as e:
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                held += len(data or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield _batch(rows, UNITS)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, UNITS)

    return todo.select("path", "kind", "content").mapInArrow(run, UNITS)


def _assembled(kind: str, data: bytes, own: pd.DataFrame, b: Backends, detector: Detector) -> tuple[bytes, str | None, bool]:
    """The new file, a report on its pixels, and whether they were found clean."""
    if kind == "text":
        return own["value"].iloc[0].encode(), None, True
    if kind == "audio":
        return media.spoken(own["value"].iloc[0], b), None, True
    if kind in media.REDACT or kind == "dicom":
        if kind == "dicom":
            tags = own[own["part"] == TAG]
            out, report = media.redact_dicom(data, dict(zip(tags["column"], tags["value"])), b, detector)
        else:
            out, report = media.REDACT[kind](data, b, detector)
        return out, report.json(), report.clean
    if kind == "docx":
        old = {(p, i): t for p, i, t in office.read_docx(data)}
        pairs = []
        for r in own.itertuples(index=False):
            for x, y in zip(old[r.part, r.row].split(" | "), r.value.split(" | ")):
                pairs += [(x, y)] if x != y else []
        return office.rewrite_docx(data, pairs), None, True
    sheets: dict[str, tuple[list[str], list[list[str]]]] = {} if kind == "csv" else {n: ([], []) for n in office.read_xlsx(data)}
    for part, g in own.sort_values(["row", "col"]).groupby("part", sort=False):
        rows = [list(x["value"]) for _, x in g.groupby("row")]
        sheets[part] = (rows[0], rows[1:])
    if kind == "excel":
        return office.write_xlsx(sheets), None, True
    header, body = sheets.get("", ([], []))
    out = io.StringIO(newline="")
    if header:
        csv.writer(out, lineterminator="\n").writerows([header, *body])
    return out.getvalue().encode(), None, True


def assemble(u: DataFrame, todo: DataFrame, backends: Backends, detector: Detector) -> DataFrame:
    """(path, content, report, clean, error) of every file with units. A file's
    bytes are one row beside its units."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        file = frame[frame["kind"].notna()].iloc[0]
        own = frame[frame["part"].notna()]
        data = bytes(file["content"]) if file["content"] is not None else b""
        try:
            made = (*_assembled(file["kind"], data, own, backends, detector), None) if len(own) else (b"" if file["kind"] == "csv" else None, None, True, None)
        except Exception as e:
            made = None, None, False, f"{type(e).__name__}: {e}"
        return pd.DataFrame([(file["path"], *made)], columns=["path", "content", "report", "clean", "error"])

    whole = u.where("error is null").select("path", "part", "row", "col", "column", "value")
    file = todo.join(u.where("error is not null").select("path").distinct(), "path", "left_anti").select("path", "kind", F.when(F.col("kind").isin(*WHOLE), F.col("content")).alias("content"))
    return whole.unionByName(file, allowMissingColumns=True).groupBy("path").applyInPandas(run, "path string, content binary, report string, clean boolean, error string")


def told_columns(u: DataFrame, columns: Callable[[list[str], list[dict]], list[str]], sample: int = 5) -> DataFrame:
    """(path, part, column) to be masked whole, told by a call from each table's
    header and first rows; nothing but these reaches it."""

    def told(cells: list[tuple]) -> list[str]:
        names, body = [c for r, c, _ in cells if r < 0], {}
        for r, c, v in cells:
            if r >= 0:
                body.setdefault(r, {})[c] = v
        said = set(columns(names, list(body.values())))
        return [c for c in dict.fromkeys(names) if c in said]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, cells = b.column(2).offsets.to_pylist(), b.column(2).flatten()
            ends, cells = [e - ends[0] for e in ends], list(zip(*(cells.field(k).to_pylist() for k in ("row", "column", "value"))))
            own = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends, ends[1:])
            yield _batch([(path, part, c) for path, part, lo, hi in own for c in told(cells[lo:hi])], told_as)

    told_as = "path string, part string, column string"
    few = u.where((F.col("row") < sample) & F.col("column").isNotNull() & (F.col("part") != TAG)).select("path", "part", "row", "col", "column", "value")
    # One row a table: a frame a table costs many times what is done with it.
    tables = spread(few, "path", "part").groupBy("path", "part").agg(F.array_sort(F.collect_list(F.struct("row", "col", "column", "value"))).alias("cells"))
    return tables.mapInArrow(run, told_as)


def deidentify_units(u: DataFrame, detector: Detector, passes: int, most: int = 8000, salt: str = "", columns: Callable | None = None, **calls) -> DataFrame:
    """`u` with values moved, masked and redacted, `fault` (why a call
    failed) and `left` (the last check still found something). `u` has `days` too;
    headers stay. Tags follow their own policy, and only
    those of free text are read by the detector."""
    tag = F.coalesce(F.col("part") == TAG, F.lit(False))
    cell = (F.col("row") >= 0) & ~tag
    if columns is None:
        u = u.withColumn("masked", F.col("column").isNotNull() & F.col("column").rlike(IDENTIFIER))
    else:
        told = told_columns(u, columns).withColumn("masked", F.lit(True))
        u = u.join(told, ["path", "part", "column"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))
    free = tag & F.col("column").isin(*sorted(dicom.FREE_TEXT))
    body = cell | free
    value = F.when(cell & F.col("masked"), mask(F.col("value"))).when(body, dates.shift_text(F.col("value"), F.col("days")))
    value = value.when(tag, dicom.anonymise_tag(F.col("column"), F.col("value"), F.col("days"), salt)).otherwise(F.col("value"))
    key = F.xxhash64("path", "part", "row", "col")
    none = F.lit(None).cast("string")
    u = u.withColumns({"value": value, "key": key, "fault": none, "left": F.lit(False)})
    for n in range(passes + 1):
        u = durable(u)
        open_ = u.where(body & is_open(F.col("value")) & F.col("error").isNull() & F.col("fault").isNull())
        pieces = chunks(open_, "key", "value", most if n == 0 else most // 2)
        found = detect(pieces.select(F.concat_ws("/", "doc_id", "chunk_no").alias("unit"), F.lit("").alias("col"), F.col("chunk").alias("text")), detector, **calls)
        # Written, as a detector need not answer alike when asked again.
        found = durable(found.where("error is not null or not text rlike '^[*]+$'").withColumn("_k", F.split("unit", "/")[0].cast("long")))
        u = u.withColumn("left", F.lit(False)) if n else u
        if found.isEmpty():
            break
        per = found.groupBy("_k").agg(F.collect_set("text").alias("_t"), F.max("error").alias("_e"))
        u = u.join(per, u["key"] == per["_k"], "left")
        u = u.withColumns(
            {
                "value": F.when(F.size("_t") > 0, redact_literals(F.col("value"), F.col("_t"))).otherwise(F.col("value")),
                "fault": F.coalesce("fault", "_e"), "left": F.coalesce(F.size("_t") > 0, F.lit(False)),
            }
        ).drop("_k", "_t", "_e")
    return u


def deidentify_directory(
    spark: SparkSession, root: str, out: str, salt: str = "", detector: Detector | None = None, passes: int = 3, hashes: bool = True, allow_unverified: bool = False, recursive: bool = True,
    backends: Backends | None = None, columns: Callable | None = None, names: Detector | None = None, kinds: Callable | None = None, skip_existing: bool = False, mappings: bool = True, audit: bool = False, rounds: int = 3,
    **calls,
) -> DataFrame:
    """Every new or changed file under `root` (a folder or one file), written
    under `out` by its alias. One result row a file: input_path, output_path,
    success, error, hash, status, retries_attempted, report.

    `backends` read and write what the library can't; `columns(names, rows)` tells
    the columns to mask; `names` finds personal data in file and folder names;
    `kinds` (a Column of the path) is asked for a kind before the extension is.
    Failures that can pass are tried again in up to `rounds` rounds, after 30, 60
    and 90 seconds. `audit` writes a file of each result row beside its output.
    With `skip_existing` a file whose output is there counts as
    done. States and aliases are kept under `out`/_tables, a version each run,
    and make the next run go on from there; mapping files (`mappings`) lie beside
    the outputs, and are where a run without tables goes on from.
    """
    detector, backends = detector or RuleDetector(), backends or Backends()
    tables = Versions(spark, f"{out}/_tables", "state")
    found = files.scan(spark, root, recursive).withColumn("hash", state.file_hash(F.col("content")))
    if kinds is not None:
        found = found.withColumn("kind", F.coalesce(kinds(F.col("path")), F.col("kind")))
    known = tables.read("state", state.SCHEMA)
    todo = state.pending(found, known, hashes)
    name, depth = base_name(F.col("path")), F.size(F.split("path", "/"))
    todo = todo.withColumn("name", name).withColumn("folder", F.when(depth > 1, F.substring("path", F.lit(1), F.length("path") - F.length(name) - 1)).otherwise(F.lit("")))
    folder_parts = todo.select(F.explode(F.split("folder", "/")).alias("folder")).where("folder <> ''")
    bases = None if names is None else durable(paths.detected(folder_parts.select(F.col("folder").alias("n")).unionByName(todo.select(F.col("name").alias("n"))), "n", names, **calls))
    old_folders, old_files = tables.read("folders", FOLDERS), tables.read("files", FILES)
    csv_folders, csv_files = files.read_mappings(spark, out)
    csv_folders = csv_folders.join(old_folders.select("folder"), "folder", "left_anti")
    csv_folders = csv_folders.select("folder", F.regexp_replace("alias", r"_\d{3,}$", "").alias("base"), paths.resumed_counter(F.col("alias"), 3).alias("counter"), "alias")
    folders = durable(paths.alias_folders(todo.select("path"), old_folders.unionByName(csv_folders), bases))
    parts = todo.select("folder", F.posexplode(F.split("folder", "/")).alias("n", "part")).distinct().join(folders.select(F.col("folder").alias("part"), F.col("alias").alias("as")), "part", "left")
    each = F.struct("n", F.coalesce("as", "part").alias("as"))
    where = durable(parts.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["as"]), "/").alias("to_folder")))
    csv_files = csv_files.join(where, "to_folder").select("folder", "name", F.regexp_replace("alias", r"_\d{4,}(\.[^.]*)?$", "$1").alias("base"), paths.resumed_counter(F.col("alias"), 4).alias("counter"), "alias")
    csv_files = csv_files.join(old_files.select("folder", "name"), ["folder", "name"], "left_anti")
    aliases = durable(paths.alias_files(todo.select("folder", "name"), old_files.unionByName(csv_files), bases))
    # A subject is a top folder, or a file that lies beside them.
    subject = F.when(depth > 1, F.split("path", "/")[0]).otherwise(stem(F.col("path")))
    target = F.concat_ws("/", F.when(F.col("folder") != "", F.col("to_folder")), "alias")
    todo = todo.join(aliases.select("folder", "name", "alias"), ["folder", "name"]).join(where, "folder").withColumns({"to": target, "days": dates.subject_offset(subject, salt)})
    existing = None
    if skip_existing:
        outputs = _outputs(spark, out)
        existing = todo.join(outputs, "to", "left_semi").select(
            F.col("path").alias("input_path"), F.concat(F.lit(f"{out.rstrip('/')}/"), "to").alias("output_path"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), "hash",
            F.lit("skipped").alias("status"), F.lit(0).alias("retries_attempted"), F.lit(None).cast("string").alias("report"),
        )
        todo = todo.join(outputs, "to", "left_anti")

    def process(some: DataFrame) -> DataFrame:
        return _processed(some, out, detector, backends, passes, salt, columns, allow_unverified, calls)

    sleep = calls.get("sleep", time.sleep)
    results = state.rounds(todo, process, rounds, lambda n: sleep(30 * n))
    results = durable(results if existing is None else results.unionByName(existing))
    tables.write({"folders": folders, "files": aliases, "state": state.upsert(known, state.from_results(results))})
    if audit:
        to = todo.select(F.col("path").alias("input_path"), "to")
        files.write_each(files.sidecars(results.where("success").join(to, "input_path")), out).write.format("noop").mode("overwrite").save()
    if mappings:
        _write_mappings(results, folders, aliases, where, bases, out)
    return results


def _outputs(spark: SparkSession, out: str) -> DataFrame:
    """(to) of the files that lie under `out`."""
    try:
        return files.scan(spark, out, content=False).where(~F.col("path").startswith("_tables/")).select(F.col("path").alias("to"))
    except Exception:
        return spark.createDataFrame([], "to string")


def _processed(todo: DataFrame, out: str, detector: Detector, backends: Backends, passes: int, salt: str, columns: Callable | None, allow_unverified: bool, calls: dict) -> DataFrame:
    """Result rows of `todo`, whose outputs are written; what is no output is
    left nowhere."""
    u = units(todo, backends).join(todo.select("path", "days"), "path")
    u = durable(deidentify_units(u, detector, passes, salt=salt, columns=columns, **calls))
    judged = u.groupBy("path").agg(F.coalesce(F.max("error"), F.max("fault")).alias("why"), F.max("left").alias("left"))
    made = durable(assemble(u, todo, backends, detector))
    empty = todo.where(F.col("length") == 0).select("path", "content", F.lit(None).cast("string").alias("report"), F.lit(True).alias("clean"), F.lit(None).cast("string").alias("error"))
    made = made.where("content is not null or error is not null")
    made = made.unionByName(empty.join(made.select("path"), "path", "left_anti"))
    status = F.when(F.col("why").isNotNull(), "failed").when(F.col("left") | ~F.coalesce("clean", F.lit(True)), "unverified").otherwise("clean")
    ready = durable(todo.select("path", "hash", "to").join(judged, "path", "left").join(made, "path", "left").withColumn("status", status))
    good = (F.col("content").isNotNull()) & ((F.col("status") == "clean") | F.lit(allow_unverified) & (F.col("status") == "unverified"))
    written = files.write_each(ready.where(good).select(F.col("to").alias("path"), "content"), out).withColumnRenamed("input_path", "to")
    results = ready.join(written.select("to", "output_path", F.col("success").alias("ok"), F.col("error").alias("write_error")), "to", "left").select(
        F.col("path").alias("input_path"), "output_path", F.coalesce("ok", F.lit(False)).alias("success"), F.coalesce("write_error", "why", "error", F.when(~F.coalesce("ok", F.lit(False)), F.col("status"))).alias("error"),
        "hash", "status", F.lit(0).alias("retries_attempted"), "report",
    )
    return durable(results)


def _write_mappings(results: DataFrame, folders: DataFrame, aliases: DataFrame, where: DataFrame, bases: DataFrame | None, out: str) -> None:
    """One file of changed folder names, and one of changed file names in every
    output folder; one row a name, in its order."""

    def table(df: DataFrame, original: str, kind: str) -> DataFrame:
        if bases is None:
            df = df.withColumn("found", paths.numbers_in(F.col(original)))
        else:
            df = df.join(bases.select(F.col("name").alias(original), "found"), original, "left").withColumn("found", F.coalesce("found", paths.numbers_in(F.col(original))))
        rows = paths.mapping_table(df, original, "found", "to")
        line = F.to_csv(F.struct("original", "anonymized", "phi_values", "phi_categories"), {"escape": '"', "quoteAll": "false"})
        rows = rows.groupBy("to").agg(F.concat_ws("\n", F.sort_array(F.collect_list(line))).alias("lines"))
        head = f"original_{kind},anonymized_{kind},phi_values,phi_categories\n"
        return rows.select(F.col("to").alias("path"), F.concat(F.lit(head), "lines", F.lit("\n")).cast("binary").alias("content"))

    done = folders.withColumn("to", F.lit(files.FOLDER_CSV))
    own = aliases.join(where, "folder").withColumn("to", F.concat_ws("/", F.when(F.col("folder") != "", F.col("to_folder")), F.lit(files.FILE_CSV)))
    both = table(done, "folder", "foldername").unionByName(table(own, "name", "filename"))
    files.write_each(both, out).write.format("noop").mode("overwrite").save()

"""Queries that go through whole files: units of texts and tables, images, DICOM
files and sound rendered from the shared tables, with scripted models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audio, dicom, media, paths, tabular
from ..operators.detectors import RuleDetector
from ..sources import pixels as px
from ..sources.shared import spread
from .catalog import DAYS, _customers, query, table
from .pipeline import told_columns, units


@query(
    """select doc_id || '.txt' as path, 'text' as part, 0::bigint as row, 0 as col, null::varchar as "column", coalesce(text, '') as value from documents union all
select c_custkey || '.csv', '', r, k, case k when 0 then 'key' else 'name' end, case when r < 0 then case k when 0 then 'key' else 'name' end when k = 0 then c_custkey::varchar else c_name || ', "x"' end
from customer, (values (-1), (0)) a(r), (values (0), (1)) b(k)"""
)
def directory_units(spark, sf_dir):
    """Text and CSV files as units of text."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("text").alias("kind"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    row = F.concat(F.lit("key,name\n"), F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit(', ""x"""\n'))
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".csv")).alias("path"), F.lit("csv").alias("kind"), F.encode(row, "utf-8").alias("content"))
    return units(d.unionByName(c)).select("path", "part", "row", "col", "column", "value")


@query(
    """select c_custkey || '.csv' as path, unnest(case when c_custkey % 2 = 0 then ['key', 'name'] else ['name'] end) as "column" from customer"""
)
def directory_columns_told(spark, sf_dir):
    """Columns to mask, told from a table's header and first rows alone."""
    row = F.concat(F.lit("key,name\n"), F.col("c_custkey").cast("string"), F.lit(","), "c_name", F.lit("\n"))
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".csv")).alias("path"), F.lit("csv").alias("kind"), F.encode(row, "utf-8").alias("content"))
    tell = lambda names, rows: [n for n in names if "#" in rows[0][n] or (rows[0][n].isdigit() and int(rows[0][n]) % 2 == 0)]
    return told_columns(units(c), tell).select("path", "column")


def _reader(reading: str):
    """Reads one text in a fixed place until that is hidden."""
    return lambda p: [{"text": reading, "x": 5, "y": 5, "width": 10, "height": 6, "confidence": 0.9}] if np.ptp(p[5:11, 5:15]) > 0 else []


def _rendered(width: int, height: int, kind=np.uint8) -> np.ndarray:
    return (1 + np.add.outer(np.arange(height), np.arange(width)) % 200).astype(kind)


@query(
    """with i as (select p_partkey, 20 + p_size as w, 12 + p_size % 30 as h, p_partkey % 2 = 0 as private, p_partkey % 3 = 0 as face from part),
x as (select *, case when private then least(w, 20) * least(h, 16) else 0 end as a, case when face then least(w, 40) * least(h, 42) else 0 end as b from i)
select p_partkey, w as width, h as height, cast(greatest(a, b) as bigint) as hidden_pixels, cast(private as int) as n_texts, cast(face as int) as n_faces, true as clean from x"""
)
def image_redaction(spark, sf_dir):
    """Images through reading, hiding of texts and faces, and a check; the pixels
    hidden are counted in the new files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                key = int(r.p_partkey)
                size = 32 if key % 3 == 0 else 20
                b = media.Backends(ocr=_reader("12345678" if key % 2 == 0 else "plain"), faces=lambda p, size=size: [{"x": 0, "y": 0, "width": 30, "height": size, "confidence": 0.9}])
                p = _rendered(20 + int(r.p_size), 12 + int(r.p_size) % 30)
                data, report = media.redact_image(px.write_png(np.stack([p] * 3, -1)), b)
                p = px.read_png(data)
                out.append((key, p.shape[1], p.shape[0], int((p == 0).all(-1).sum()), report.texts, sum(report.faces), report.clean))
            yield pd.DataFrame(out, columns=["p_partkey", "width", "height", "hidden_pixels", "n_texts", "n_faces", "clean"])

    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").mapInPandas(run, "p_partkey long, width int, height int, hidden_pixels long, n_texts int, n_faces int, clean boolean")


@query(
    f"""select c_custkey, 1 + c_custkey % 3 as n_frames, cast((1 + c_custkey % 3) * 40 * 48 as bigint) as low_pixels, cast(1 + c_custkey % 3 as int) as n_faces,
  '' as "PatientName", strftime(date '2100-01-01' + cast(c_custkey % 9000 as int) + {DAYS}, '%Y%m%d') as "StudyDate", 'call ' || repeat('*', 17) as "StudyDescription" from customer"""
)
def dicom_redaction(spark, sf_dir):
    """DICOM files decoded, their tags rewritten by the policy, texts and faces
    hidden in every frame at full depth, and written; read again and measured."""
    day = F.date_format(F.date_add(F.lit("2100-01-01").cast("date"), (F.col("c_custkey") % 9000).cast("int")), "yyyyMMdd")
    tags = F.create_map(F.lit("PatientName"), F.col("c_name"), F.lit("StudyDate"), day, F.lit("StudyDescription"), F.lit("call +1 (017) 555-7713"))
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", tags.alias("old"), dicom.anonymise_tags(tags, DAYS).alias("new"))
    names = ["PatientName", "StudyDate", "StudyDescription"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = media.Backends(ocr=_reader("12345678"), faces=lambda p: [{"x": 0, "y": 0, "width": 30, "height": 38, "confidence": 0.5}])
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                n = 1 + r.c_custkey % 3
                p = np.stack([_rendered(48, 64, np.uint16) * 9 + 100] * n)
                data, report = media.redact_dicom(px.write_dicom(px.new_dicom(p if n > 1 else p[0], dict(r.old))), dict(r.new), b)
                d = px.read_dicom(data)
                q = d.pixels()
                out.append((r.c_custkey, 1 if q.ndim == 2 else len(q), int((q == q.min()).sum()), sum(report.faces), *(d.tags()[k] for k in names)))
            yield pd.DataFrame(out, columns=["c_custkey", "n_frames", "low_pixels", "n_faces", *names])

    return c.mapInPandas(run, "c_custkey long, n_frames long, low_pixels long, n_faces int, " + ", ".join(f"{k} string" for k in names))


@query("select conv_id, turn, cast(24000 * (2 + turn % 4) // 3 + 7200 + 8000 as bigint) as n_samples from conversations")
def sound_redaction(spark, sf_dir):
    """Transcripts with starred parts as sound: words, a tone, words."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("call him"), F.expr("repeat(' now', cast(turn % 4 as int))"), F.lit(" ******* end")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = [len(audio.from_wav(media.spoken(t, media.Backends()))[0]) for t in f["text"]]
            yield f[["conv_id", "turn"]].assign(n_samples=n)

    return t.mapInPandas(run, "conv_id long, turn long, n_samples long")


@query("select count(*) filter (where o_orderkey % 3 = 0) as n_rows, count(*) filter (where o_orderkey % 3 = 0) as n_cells, 2 * count(*) filter (where o_orderkey % 3 = 0) as n_changes from orders")
def rows_touched(spark, sf_dir):
    """Rows and cells of which a date moved, and dates in all."""
    note = F.when(F.col("o_orderkey") % 3 == 0, F.lit("2140-09-25, 2140-09-26 and 2140-09-25")).otherwise("none")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(tabular.INDEX), note.alias("note"), F.lit("x").alias("other"))
    return tabular.rows_touched(tabular.date_log(o, DAYS))


@query(
    """select c_custkey - 1 as _row_index, repeat('*', length(c_name)) as c_name,
  case c_custkey % 4 when 0 then 'call ' || repeat('*', 17) when 1 then 'on ' || strftime(date '2140-09-25' + 400, '%Y-%m-%d') when 2 then 'id ' || repeat('*', 8) || ' here' else 'plain ' || c_custkey % 10 end as note, 'clean' as _status from customer"""
)
def table_cells_redacted(spark, sf_dir):
    """The phases over a table that holds dates, numbers and telephone numbers."""
    k = F.col(tabular.INDEX) + 1
    note = F.when(k % 4 == 0, F.lit("call +1 (017) 555-7713")).when(k % 4 == 1, F.lit("on 2140-09-25")).when(k % 4 == 2, F.lit("id 12345678 here")).otherwise(F.concat(F.lit("plain "), (k % 10).cast("string")))
    return tabular.deidentify(_customers(spark, sf_dir).select(tabular.INDEX, "c_name", note.alias("note")), DAYS).table.drop("_failed")


@query(
    """select 'scan_' || lpad(c_custkey::varchar, 9, '0') || '_20240102.png' as name, 'scan_ID_DATE.png' as base, '20240102; ' || lpad(c_custkey::varchar, 9, '0') as phi_values, 'DATE; ID' as phi_categories from customer"""
)
def names_found(spark, sf_dir):
    """What makes up a file name's placeholder."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("scan_"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("_20240102.png")).alias("name"))
    join = lambda k: F.array_join(F.transform(paths.numbers_in(F.col("name")), lambda x: x[k]), "; ")
    return c.select("name", paths.placeholder(F.col("name")).alias("base"), join("value").alias("phi_values"), join("category").alias("phi_categories"))


@query(
    """select 'mail_' || c_custkey || '@x.example.com_note.txt' as name, 'EMAIL.txt' as base from customer union all select 'note ' || lpad(c_custkey::varchar, 8, '0') || '.txt', 'note ID_NUMBER.txt' from customer"""
)
def names_detected(spark, sf_dir):
    """Names whose personal data a detector finds, as placeholders by kind."""
    k = F.col("c_custkey").cast("string")
    c = table(spark, sf_dir, "customer")
    both = c.select(F.concat(F.lit("mail_"), k, F.lit("@x.example.com_note.txt")).alias("name")).unionByName(c.select(F.concat(F.lit("note "), F.lpad(k, 8, "0"), F.lit(".txt")).alias("name")))
    rules = {**text.RULES, "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+", "id_number": r"(?<![0-9])[0-9]{6,}(?![0-9])"}
    return paths.detected(both, "name", RuleDetector(rules)).select("name", "base")

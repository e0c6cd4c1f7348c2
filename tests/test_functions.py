"""Scalar specifications, table-driven, and properties."""

import re
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from larkspur.functions import dates, geometry, text
from pyspark.sql import functions as F

SHIFTS = [
    ("2140-09-25", 400, "2141-10-30"), ("2140-09-25 07:15:00", -400, "2139-08-22 07:15:00"), ("2140-09-25T07:15:00", 400, "2141-10-30T07:15:00"),
    ("2140-09-25 7:15PM", 400, "2141-10-30 07:15PM"), ("2140-09-25 7:15 pm", 400, "2141-10-30 07:15 PM"), ("2140-09-25  07:15:00", 1, "2140-09-26 07:15:00"),
    ("25.09.2140", -730, "26.09.2138"), ("03/04/2024", 400, "08/05/2025"), ("02/13/2024", 400, "03/19/2025"), ("SEPTEMBER 5, 2140", 400, "October 10, 2141"),
    ("Sep 25, 2140", 400, "Oct 30, 2141"), ("Sep 25 2140", 400, None), ("5 May 2140", -365, "06 May 2139"), ("2024-02-30", 400, None), ("2024-02-29", 365, "2025-02-28"),
    ("2140-09-25 13:15PM", 400, None), ("2140", 400, "2141"), ("2140", -400, "2138"), ("2011 - 2013", -366, "2009 - 2011"), ("2011–2013", 400, "2012–2014"),
    ("07:15:00", 400, "07:15:00"), ("7:15", 400, "07:15"), ("2140-09-25 07:15:00.5", 1, "2140-09-26 07:15:00.500000"), ("02-13-2024", 1, "02-14-2024"),
    ("25.09.2140 07:15", 1, "26.09.2140 07:15"), ("nothing", 5, None), ("", 5, None), (None, 5, None),
]


def one(spark, value, make, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return df.select(make(F.col("c")).alias("r")).first().r


def test_shift(spark):
    df = spark.createDataFrame([(i, s, d) for i, (s, d, _) in enumerate(SHIFTS)], "i int, s string, d int")
    got = {r.i: r.r for r in df.select("i", dates.shift(F.col("s"), F.col("d")).alias("r")).collect()}
    assert [got[i] for i in range(len(SHIFTS))] == [x for _, _, x in SHIFTS]


TEXTS = [
    ("seen 2140-09-25 13:15PM.", 400, "seen 2141-10-30 13:15PM."), ("2140-09-25 07:15 b", 1, "2140-09-26 07:15 b"), ("2140-09-25T07:15:00.123", 1, "2140-09-26T07:15:00.123"),
    ("_2140-09-25 é2140-09-25 id12140-09-25", 1, "_2140-09-25 é2140-09-25 id12140-09-25"), ("2024-01-01 and 2025-01-01", 366, "2025-01-01 and 2026-01-02"),
    ("Sep 25 2140, 2024-02-30", 9, "Sep 25 2140, 2024-02-30"), ("on 03/04/2024 or 5 May 2140", 1, "on 04/04/2024 or 06 May 2140"), ("", 1, ""), (None, 1, None),
]


def test_shift_text(spark):
    df = spark.createDataFrame([(i, s, d) for i, (s, d, _) in enumerate(TEXTS)], "i int, s string, d int")
    got = {r.i: r.r for r in df.select("i", dates.shift_text(F.col("s"), F.col("d")).alias("r")).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [x for _, _, x in TEXTS]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.datetimes(datetime(1900, 1, 1), datetime(2199, 12, 31)), st.integers(-1095, 1095)), min_size=5, max_size=20))
def test_shift_can_be_undone(spark, rows):
    df = spark.createDataFrame([(d.strftime("%Y-%m-%d"), n) for d, n in rows], "s string, n int")
    df = df.select("s", "n", dates.shift(F.col("s"), F.col("n")).alias("t")).select("s", "n", "t", dates.shift(F.col("t"), -F.col("n")).alias("back"))
    for r in df.collect():
        assert r.back == r.s and datetime.strptime(r.t, "%Y-%m-%d") == datetime.strptime(r.s, "%Y-%m-%d") + timedelta(r.n)


def test_offsets(spark):
    df = spark.range(2000).select(dates.subject_offset(F.col("id").cast("string"), "s").alias("d")).collect()
    values = [r.d for r in df]
    assert all(365 <= abs(v) <= 1095 for v in values) and {v > 0 for v in values} == {True, False} and len(set(values)) > 500


def test_tag_dates(spark):
    assert [one(spark, v, lambda c: dates.shift_tag(c, 400)) for v in ("21400925", "2140-09-25", "21400231", "", None)] == ["21411030", "2140-09-25", "21400231", "", None]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1@. 4𝒳é\n+-()5", max_size=60), min_size=1, max_size=20))
def test_redaction_keeps_lengths_and_leaves_nothing(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.redact(F.col("t")).alias("r"))
    df = df.withColumn("again", text.redact(F.col("r"))).withColumn("left", F.size(text.hits(F.col("r"))))
    for r in df.collect():
        assert len(r.r) == len(r.t) and r.again == r.r and r.left == 0


def test_redact_and_mask(spark):
    t = "mail und.34@mail7.example.com, +1 (017) 555-7713, 4929348385146306 97.51.17.173 x"
    want = re.sub(r"[^ ,]+@[^ ,]+|\+1 \(\d+\) [\d-]+|\d{16}|[\d.]{9,}", lambda m: "*" * len(m[0]), t)
    assert one(spark, t, text.redact) == want
    assert [one(spark, v, text.mask) for v in ("ab𝒳", "", None)] == ["***", "", None]
    assert [one(spark, v, text.stars) for v in ("ab", " ", "")] == ["**", "", ""]
    assert [one(spark, v, text.is_open) for v in ("ab", "***", "", "*a")] == [True, False, False, True]
    lits = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, "Jon Jonas Jo", lambda c: text.redact_literals(c, lits("Jo", "Jonas", "", " "))) == "**n ***** **"
    assert one(spark, "aaa", lambda c: text.occurrences(c, F.lit("aa"))) == 1


def test_names_and_routes(spark):
    assert [(one(spark, n, text.extension), one(spark, n, text.stem)) for n in ("a.b.txt", ".bashrc", "x", "a.")] == [(".txt", "a.b"), ("", ".bashrc"), ("", "x"), (".", "a")]
    kinds = {"A.DCM": "dicom", "a.mov": "video", "a.JPEG": "image", "a.pdf": "pdf", "a.hea": "text", "a.csv": "csv", "a.xls": "excel", "a.docx": "docx", "a.mp3": "audio", "a.zip": None, "dcm": None}
    assert {n: one(spark, n, text.route) for n in kinds} == kinds
    df = spark.createDataFrame([("a.txt", bytearray(128) + b"DICM"), ("b.txt", bytearray(b"x"))], "n string, c binary")
    assert [r.k for r in df.select(text.route(F.col("n"), F.col("c")).alias("k")).collect()] == ["dicom", "text"]
    assert [one(spark, p, text.is_hidden) for p in ("a/.b/c", ".x", "a/b.c")] == [True, True, False]
    assert [one(spark, p, text.is_system_file) for p in ("a/Thumbs.db", "a/thumbs.DB", "b.txt")] == [True, False, False]


def test_answers(spark):
    cases = {"<think>a</think> b": "b", "a</think>b": "b", "<think>a</think>": "<think>a</think>", "x ```think\ny``` z": "x  z", "plain": "plain"}
    assert {k: one(spark, k, text.strip_thinking) for k in cases} == cases
    assert one(spark, 'so {"a": "x\ty"} ok', text.json_object) == '{"a": "xy"}' and one(spark, "none", text.json_object) is None
    assert [one(spark, s, text.last_yes_no) for s in ("no, YES", "yes... NO.", "nothing", "YESTERDAY")] == [True, False, False, False]
    assert [one(spark, s, text.pii_type) for s in ("DOB", "mrn", " Email ", "car")] == ["date_of_birth", "id_number", "email", None]
    assert [one(spark, s, text.is_retryable) for s in ("HTTP 503", "Overloaded!", "bad file")] == [True, True, False]


def test_geometry(spark):
    b = lambda *v: geometry.box(*[F.lit(x) for x in v])
    df = spark.range(1).select(
        geometry.pad_clip(b(2, 3, 10, 10), 5, F.lit(14), F.lit(100)).alias("p"), geometry.iou(b(0, 0, 10, 10), b(5, 5, 10, 10)).alias("i"), geometry.iou(b(0, 0, 0, 0), b(0, 0, 0, 0)).alias("z"),
        geometry.from_points(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.9, 2.2), (5.5, 9.9))])).alias("f"),
        geometry.rescale(b(10, 10, 20, 20), F.lit(2.5), F.lit(0.5), F.lit(60), F.lit(100)).alias("r"), geometry.fit_scale(F.lit(2048), F.lit(100)).alias("s"), geometry.fit_scale(F.lit(10), F.lit(10)).alias("t"),
    ).first()
    assert tuple(df.p) == (0, 0, 14, 18) and df.i == pytest.approx(25 / 175) and df.z == 0.0
    assert tuple(df.f) == (1, 2, 4, 7) and tuple(df.r) == (25, 5, 35, 10) and (df.s, df.t) == (0.5, 1.0)


def test_rewrite_keeps_the_mark(spark):
    rows = [("a\x01b 1.2.3.4 c\x01d",), ("\x01",), ("1.2.3.4\x015.6.7.8",), ("\x011.2.3.4",), (None,), ("x 1.2.3.4",)]
    got = [r.t for r in spark.createDataFrame(rows, "t string").select(text.redact(F.col("t")).alias("t")).collect()]
    assert got == ["a\x01b ******* c\x01d", "\x01", "*******\x01*******", "\x01*******", None, "x *******"]

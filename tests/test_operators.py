"""Detectors, tables, documents, names, state, images, sound, sources, streams."""

import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from larkspur.functions import dates
from larkspur.operators import audio, detectors, dicom, documents, paths, state, tabular, vision
from larkspur.sources import files, office
from larkspur.streaming import incremental
from pyspark.sql import functions as F

NAP = {"sleep": lambda s: None}


def people(spark, n=31):
    rows = [(i, f"1000{i}", f"seen 2024-01-0{i % 9 + 1} by Dr Who", "x@y.example.com" if i % 2 else "") for i in range(n)]
    return spark.createDataFrame(rows, "_row_index long, subject_id string, note string, contact string")


def test_tables(spark):
    r = tabular.deidentify(people(spark), 366, **NAP)
    rows = r.table.orderBy("_row_index").collect()
    assert r.masked == ["subject_id"] and r.clean and r.passes == 1
    assert rows[1].subject_id == "*****" and rows[1].note == "seen 2025-01-02 by Dr Who" and rows[1].contact == "*" * 15 and rows[0].contact == ""
    assert {x._status for x in rows} == {"clean"}


def test_tables_with_scripts(spark):
    d = detectors.ScriptedDetector([("1", "Dr Who", "name"), ("1", "not there", "name"), ("77", "Dr Who", "name")], {"3": "damaged"})
    r = tabular.deidentify(people(spark), 1, detector=d, checker=detectors.ScriptedDetector([]), batch=1, **NAP)
    rows = {x._row_index: x for x in r.table.collect()}
    assert rows[1].note.endswith("by ******") and rows[2].note.endswith("Dr Who")
    assert {i for i, x in rows.items() if x._status == "failed"} == {3}
    again = detectors.ScriptedDetector([("2", "Who", "name"), ("2", "seen", "name")])
    endless = type("Endless", (), {"detect": lambda self, u: u.head(1)[["unit", "col"]].assign(text=u["text"].iloc[0][:1], type="x")})()
    assert tabular.deidentify(people(spark, 3), 1, detector=again, checker=endless, **NAP).passes == 3


def test_index_and_differences(spark):
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(100)], "k string").repartition(7)
    got = tabular.with_index(df, "k").orderBy("k").collect()
    assert [r._row_index for r in got] == list(range(100))
    a = spark.createDataFrame([(0, "x", None), (1, "y" * 300, "b")], "_row_index long, p string, q string")
    got = {(r.row_index, r.column): tuple(r)[2:] for r in tabular.differences(a, a.withColumn("q", F.lit("*"))).collect()}
    assert got == {(0, "p"): ("UNCHANGED", "x", "x"), (0, "q"): ("CHANGED", "", "*"), (1, "p"): ("UNCHANGED", "y" * 200 + "...", "y" * 200 + "..."), (1, "q"): ("CHANGED", "b", "*")}


@pytest.mark.parametrize("n", [0, 1, 3999, 4000, 4001, 8001, 20000])
@pytest.mark.parametrize("unit", ["x", "word. ", "line\n\n"])
def test_chunks_cover(n, unit):
    t = (unit * (n // len(unit) + 1))[:n]
    got = documents.split_chunks(t, 4000)
    end = 0
    for s, c in got:
        assert len(c) <= 4000 and s <= end and t[s : s + len(c)] == c
        end = s + len(c)
    assert end == n and (n == 0) == (not got)


def test_chunk_breaks():
    t = "a" * 3800 + "\n\n" + "b" * 3000
    assert documents.split_chunks(t, 4000)[0] == (0, "a" * 3800)
    t = "a" * 3900 + ". " + "b" * 3000
    assert documents.split_chunks(t, 4000)[0] == (0, "a" * 3900 + ".")


def test_documents(spark):
    docs = spark.createDataFrame([(1, "Bo saw Bob on 2024-01-01. " + "z" * 9000 + " Bob"), (2, ""), (3, None), (4, "fine")], "doc_id long, text string")
    d = detectors.ScriptedDetector([("1/0", "Bob", "name"), ("1/0", "Bo", "name")], {"4/0": "429 rate limit"})
    out = {r.doc_id: r for r in documents.deidentify(docs, 366, detector=d, checker=detectors.ScriptedDetector([]), batch=1, **NAP).collect()}
    assert out[1].text == "** saw *** on 2025-01-01. " + "z" * 9000 + " ***"
    assert (out[2].text, out[3].text, out[4]._status, out[1]._status) == ("", None, "failed", "clean")
    pairs = spark.createDataFrame([(1, "a", "x", 0), (1, "a", "y", 1), (1, "abc", "z", 2)], "doc_id long, original string, replacement string, ord int")
    assert [tuple(p) for p in documents.merged_map(pairs).first().pairs] == [("abc", "z"), ("a", "y")]
    assert documents.paired_chunks(docs, docs).count() == 4


def test_retry():
    calls, naps = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("503 service unavailable")
        return "ok"

    assert detectors.with_retry(flaky, sleep=naps.append, jitter=0) == "ok" and naps == [2.0, 4.0]
    with pytest.raises(ValueError):
        detectors.with_retry(lambda: (_ for _ in ()).throw(ValueError("bad")), sleep=naps.append)
    assert detectors.delay(9, jitter=0) == 60 and detectors.delay(1, after=7, jitter=0) == 7 and detectors.delay(1, rng=lambda: 0.0) == 2.0
    with pytest.raises(NotImplementedError):
        detectors.ModelDetector().detect(pd.DataFrame({"unit": ["1"], "col": ["c"], "text": ["t"]}))


ITEM = [{"text": "Ann", "type": "name"}]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"pii_texts": [{"text": "Ann", "type": "name"}]}', ITEM), ('Sure! [{"text": "Ann", "type": "name"}] done', ITEM), ("<think>{</think> text: Ann\n type: Name", ITEM),
        ("**text:** 'Ann', **type:** name", ITEM), ("1. Name: Ann\n2. car: red\n- MRN: 12", [*ITEM, {"text": "12", "type": "id_number"}]), ("nothing here", []),
        ('{"pii_texts": [{"text": "A\x01nn", "type": "name"}]}', [{"text": "A\x01nn", "type": "name"}]),
    ],
)
def test_parse_items(answer, want):
    assert detectors.parse_items(answer) == want


def test_aliases(spark):
    p = spark.createDataFrame([("patient_10000001/csv/adm_20130725.csv",), ("patient_10000002/csv/adm_20130726.csv",), ("root_123456.txt",)], "path string")
    got = {r.folder: r.alias for r in paths.alias_folders(p).collect()}
    assert got == {"patient_10000001": "patient_ID_001", "patient_10000002": "patient_ID_002", "csv": "csv"}
    f = spark.createDataFrame([("a", f"x_{10**6 + i}.txt") for i in range(10001)] + [("a", "d_20130725.txt"), ("", "x_1234567.txt")], "folder string, name string")
    got = {(r.folder, r.name): r.alias for r in paths.alias_files(f).collect()}
    assert got["a", "x_1000000.txt"] == "x_ID_0001.txt" and got["a", "x_1010000.txt"] == "x_ID_10001.txt"
    assert got["a", "d_20130725.txt"] == "d_DATE_0001.txt" and got["", "x_1234567.txt"] == "x_ID.txt"
    first = paths.alias_files(f.limit(0).union(spark.createDataFrame([("a", "x_1000005.txt")], f.schema)))
    more = {r.name: r.counter for r in paths.alias_files(f.where("name like 'x_100000%' and folder = 'a'"), first).collect()}
    assert more["x_1000005.txt"] == 1 and sorted(more.values()) == list(range(1, 11))
    df = spark.createDataFrame([("x_ID_0041.txt",), ("x.txt",), ("x_ID_10001.txt",)], "a string")
    assert [r.n for r in df.select(paths.resumed_counter(F.col("a"), 4).alias("n")).collect()] == [41, 0, 10001]


def test_state(spark):
    rows = [("same", "completed", "h1"), ("changed", "completed", "old"), ("nohash", "completed", None), ("again", "failed", "h4")]
    known = spark.createDataFrame([(p, None, None, s, h, "429" if s == "failed" else None, s == "failed", 0) for p, s, h in rows], state.SCHEMA)
    now = spark.createDataFrame([("same", "h1"), ("changed", "h2"), ("nohash", "h3"), ("again", "h4"), ("new", "h5")], "path string, hash string")
    assert {r.path for r in state.pending(now, known).collect()} == {"changed", "nohash", "again", "new"}
    assert {r.path for r in state.pending(now, known, hashes=False).collect()} == {"again", "new"}
    assert tuple(state.stats(known).first()) == (4, 3, 1, 1)
    assert state.cleared(known).count() == 3 and state.failed(known, True).count() == 1


def test_matching(spark):
    assert vision.ratio("tide", "diet") == 0.25 and vision.ratio("diet", "tide") == 0.5
    assert vision.greedy_match(["Ann Lee", "Ann"], ["ann lee", "Ann Lee", "xx"]) == [0, 1]
    assert vision.greedy_match(["ab", "Johnson"], ["abcdef", "Jonson"]) == [None, 1]
    assert vision.match_score("abc", "abc" * 4) == 0.0 and vision.match_score("abcd", "xxabcdxx") == 0.9
    pii = spark.createDataFrame([("f", 0, 0, "Ann", "name"), ("f", 0, 1, "zzz", "name")], "file string, page int, pii_idx int, text string, type string")
    ocr = spark.createDataFrame([("f", 0, 0, "ann", 1, 2, 3, 4, 0.9)], "file string, page int, ocr_idx int, text string, x int, y int, width int, height int, confidence double")
    got = {r.pii_idx: (r.ocr_idx, r.x, r.score) for r in vision.match_pages(pii, ocr).collect()}
    assert got == {0: (0, 1, 1.0), 1: (None, None, None)}


def test_matching_what_remains(spark):
    what = "file string, page int, pii_idx int, text string, type string"
    seen = "file string, page int, ocr_idx int, text string, x int, y int, width int, height int, confidence double"
    rows = [("f", 0, k, t, "name") for k, t in enumerate(["Daniel Martinez", "Johnson", "Smith Ltd", "Qwerty", "zzzz", "Smith Inc"])]
    pii = spark.createDataFrame([*rows, ("g", 0, 0, "Johnson", "name")], what)
    texts = ["a", "Jonson", "daniel martinex", "", None, "Daniel Martinez"]
    ocr = spark.createDataFrame([("f", 0, k, t, k, 0, 9, 9, 0.9) for k, t in enumerate(texts)], seen)
    first = {(r.file, r.pii_idx): (r.ocr_idx, r.x) for r in vision.first_match(pii, ocr).collect()}
    assert first == {("f", 0): (2, 2), ("f", 1): (1, 1)}
    # The second is too unsure, the third too short; at 0.5 one reading serves once.
    read = [("Smith Ld", 0.9), ("Qwerty", 0.2), ("z", 0.9), ("Qwxxty", 0.4)]
    hand = spark.createDataFrame([("f", 0, k, t, 50 + k, 0, 9, 9, c) for k, (t, c) in enumerate(read)], seen)
    matched, missed = vision.match_remaining(pii, ocr, hand)
    assert {(r.file, r.pii_idx): (r.x, r.seen) for r in matched.collect()} == {("f", 0): (2, "daniel martinex"), ("f", 1): (1, "Jonson"), ("f", 2): (50, "Smith Ld"), ("f", 3): (53, "Qwxxty")}
    # "Smith Inc" resembles a text matched there, so only the others are reported.
    assert {(r.file, r.text) for r in missed.collect()} == {("f", "zzzz"), ("g", "Johnson")}
    sizes = spark.createDataFrame([(32, 16), (31, 16), (10, 10), (800, 200), (801, 200), (9, 40)], "width int, height int")
    assert vision.worth_reading(sizes).count() == 3 and vision.worth_reading(sizes, 10, 10).count() == 5 and vision.readable_whole(sizes).count() == 5


def test_suppression():
    rows = pd.DataFrame([("abc", 0, 0, 10, 10, 0.5), ("abc", 1, 0, 10, 10, 0.9), ("abc", 9, 9, 10, 10, 0.4), ("zzz", 9, 9, 10, 10, 0.3), ("abc", 50, 50, 5, 5, 0.2)], columns=vision.OCR)
    assert list(vision.suppress(rows)["confidence"]) == [0.9, 0.3, 0.2]


def test_pixels(spark):
    p = np.full((2, 20, 30, 3), 9, np.uint8)
    out = vision.hide_boxes(p, [(25, 15, 3, 3), (0, 0, 0, 5)], pad=5)
    assert (out[:, 10:, 20:] == 0).all() and (out[:, :10] == 9).all() and (p == 9).all()
    g = np.arange(600, dtype=np.uint16).reshape(20, 30)
    assert vision.fill_value("MONOCHROME1", g) == 599 and vision.fill_value("RGB", g) == 0
    assert vision.display(g).max() == 255 and vision.display(g, "MONOCHROME1")[0, 0] == 255
    assert (vision.display(np.full((2, 2, 3), 128, np.uint8), "YBR_FULL") == 128).all()
    m = np.zeros((4, 4))
    m[0, 0] = 1
    assert (vision.apply_mask(g, m) == 0).sum() == 5 * 8
    images = spark.createDataFrame([("f", [20, 30], "uint16", "MONOCHROME1", bytearray(g.tobytes())), ("g", [20, 30], "uint16", "MONOCHROME2", bytearray(g.tobytes()))], "file string, shape array<int>, dtype string, photometric string, pixels binary")
    boxes = spark.createDataFrame([("f", 0, 0, 5, 5)], "file string, x int, y int, width int, height int")
    got = {r.file: np.frombuffer(r.pixels, np.uint16).reshape(20, 30) for r in vision.hide_in_files(images, boxes).collect()}
    assert (got["f"][:10, :10] == 599).all() and (got["g"] == g).all()


def test_tags(spark):
    tags = {"PatientName": "A^B", "StudyDate": "21400925", "ContentDate": "", "StudyInstanceUID": "1.2.3", "Modality": "MR", "ImageComments": "mail a@b.example.com", "NumberOfFrames": "4"}
    df = spark.createDataFrame([(tags, [4, 8, 9]), (tags, [8, 9, 3])], "t map<string,string>, s array<int>")
    a, b = df.select(dicom.anonymise_tags(F.col("t"), 400).alias("t"), dicom.info(F.col("s"), F.col("t")).alias("i")).collect()
    assert (a.t["PatientName"], a.t["StudyDate"], a.t["ContentDate"], a.t["Modality"]) == ("", "21411030", "", "MR")
    assert a.t["StudyInstanceUID"] == b.t["StudyInstanceUID"] and a.t["StudyInstanceUID"].startswith("2.25.") and len(a.t["StudyInstanceUID"]) <= 64
    assert a.t["ImageComments"] == "mail " + "*" * 15 and (a.i.is_video, a.i.frame_count, a.i.height, a.i.width) == (True, 4, 8, 9)
    out = df.select(dicom.redact_everywhere(F.col("t"), F.lit("M")).alias("t")).first().t
    assert out["Modality"] == "*R"


def test_sound(spark):
    b = audio.beep()
    assert len(b) == 7200 and b.dtype == np.float32 and b[0] == 0 and abs(b).max() <= 0.5
    df = spark.createDataFrame([("hi *** and ** a*b",), ("****",), ("",)], "t string")
    got = [[tuple(x) for x in r.p] for r in df.select(audio.plan(F.col("t")).alias("p")).collect()]
    assert got == [[("speech", "hi"), ("beep", "***"), ("speech", "and"), ("beep", "**"), ("speech", "a*b")], [("beep", "****")], []]
    samples, rate = audio.from_wav(audio.to_wav(audio.render(got[0])))
    assert rate == 24000 and len(samples) == len(audio.render(got[0])) and len(audio.render([])) == 24000


def test_files(spark, tmp_path):
    for name, data in (("a/x.txt", "héllo"), ("a/.h/y.txt", "no"), ("b/Thumbs.db", "no"), ("b/t.csv", 'k,v\n1,"q ""z""\nw"\n2,\n'), ("z.txt", "x" * 128 + "DICM")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(data)
    got = {r.path: r.kind for r in files.scan(spark, str(tmp_path / "in")).collect()}
    assert got == {"a/x.txt": "text", "b/t.csv": "csv", "z.txt": "dicom"}
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "in/b/t.csv")).collect()] == [("1", 'q "z"\nw'), ("2", "")]
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    assert [r.is_valid for r in files.read_texts(spark, str(tmp_path / "bad.txt")).collect()] == [False]
    out = spark.createDataFrame([("o/1.txt", bytearray(b"one")), ("../evil", bytearray(b"x"))], "path string, content binary")
    done = {r.input_path: r.success for r in files.write_each(out, str(tmp_path / "out")).collect()}
    assert done == {"o/1.txt": True, "../evil": False} and (tmp_path / "out/o/1.txt").read_bytes() == b"one" and not (tmp_path / "evil").exists()
    assert files.zip_outputs(str(tmp_path / "out"), str(tmp_path / "o.zip")) == 1
    assert files.read_table_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_office(spark):
    book = {"S1": (["id", "näme"], [["1", "a<b"], ["2", ""]]), "empty": (["h"], []), "none": ([], [])}
    data = office.write_xlsx(book)
    assert office.read_xlsx(data) == book
    buf = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda *t: "<w:p>" + "".join(f"<w:r><w:t>{x}</w:t></w:r>" for x in t) + "</w:p>"
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{run('Dear ', 'Ann')}{run(' ')}<w:tbl><w:tr><w:tc>{run('Ann')}</w:tc><w:tc>{run('x')}</w:tc></w:tr></w:tbl></w:body></w:document>")
    assert office.read_docx(buf.getvalue()) == [("paragraph", 0, "Dear Ann"), ("table", 0, "Ann | x")]
    new = office.rewrite_docx(buf.getvalue(), [("Ann", "***"), ("Dear Ann", "D")])
    assert office.read_docx(new) == [("paragraph", 0, "D"), ("table", 0, "*** | x")]
    df = spark.createDataFrame([("a.xlsx", bytearray(data)), ("b.xlsx", bytearray(b"no"))], "path string, content binary")
    rows = office.workbook_rows(df).collect()
    assert len(rows) == 3 and [r.path for r in rows if r.error] == ["b.xlsx"]
    assert office.document_parts(spark.createDataFrame([("d", bytearray(buf.getvalue()))], "path string, content binary")).count() == 2


def test_stream(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("2024-01-01")
    seen = []

    def process(f):
        seen.append(sorted(r.path.rsplit("/", 1)[1] for r in f.collect()))
        return f.select(F.col("path").alias("input_path"), F.lit("o").alias("output_path"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), "hash", F.lit(0).alias("retries_attempted"))

    go = lambda: incremental.process_new(spark, str(root), str(tmp_path / "state"), str(tmp_path / "cp"), process)
    go()
    go()
    (root / "b.txt").write_text("x")
    go()
    assert seen == [["a.txt"], ["b.txt"]]
    assert spark.read.parquet(str(tmp_path / "state/current")).count() == 2


def test_stream_and_batch_windows_agree(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    e.write.parquet(str(tmp_path / "e"))
    s = incremental.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")))
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.window_start, r.event_type, r.n)
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, incremental.windowed_counts(e).collect()))


def test_shift_intervals_by_subject(spark):
    df = spark.createDataFrame([(f"p{i % 5}", f"2024-01-{i + 1:02d}") for i in range(20)], "p string, d string")
    out = df.select("p", "d", dates.shift(F.col("d"), dates.subject_offset(F.col("p"))).alias("s")).withColumn("n", F.datediff(F.to_date("s"), F.to_date("d")))
    assert all(r.k == 1 for r in out.groupBy("p").agg(F.countDistinct("n").alias("k")).collect())


class Counting(detectors.RuleDetector):
    def __init__(self, log):
        super().__init__()
        self.log = log

    def detect(self, units):
        with open(self.log, "a") as f:
            f.writelines(f"{u}\n" for u in units["unit"])
        return super().detect(units)


def test_documents_are_checked_where_they_lie(spark, tmp_path):
    log = str(tmp_path / "asked")
    docs = spark.createDataFrame([(1, "id 1234567 and 1234567", "a"), (2, "plain", "b"), (None, "id 7654321", "c"), (4, None, "d"), (5, "x" * 3995 + " 12345678", "e"), (2, "12345678 is in plain", "f"), (None, "321 id", "g")], "doc_id long, text string, other string").coalesce(1)
    out = documents.deidentify(docs, 1, detector=Counting(log), **NAP)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == [
        (1, f"id {'*' * 7} and {'*' * 7}", "a", "clean"), (2, "plain", "b", "clean"), (None, f"id {'*' * 7}", "c", "clean"), (4, None, "d", "clean"), (5, "x" * 3995 + f" {'*' * 8}", "e", "clean"),
        (2, f"{'*' * 8} is in plain", "f", "clean"), (None, "321 id", "g", "clean"),
    ]
    # Once in the pass and once in the check, each unit.
    assert sorted(open(log).read().split()) == sorted([*["1/0", "2/0", "#2/0", "5/0", "2#5/0", "#6/0"] * 2, "5/1"])
    # What only a check finds is checked again, by itself.
    late = documents.deidentify(docs, 1, detector=detectors.ScriptedDetector([]), checker=Counting(str(tmp_path / "late")), **NAP)
    assert {r.other: r._status for r in late.collect()} == dict.fromkeys("abcdefg", "clean")
    assert open(tmp_path / "late").read().split().count("2/0") == 1 and open(tmp_path / "late").read().split().count("1/0") == 2
    endless = documents.deidentify(docs, 1, checker=detectors.ScriptedDetector([("2/0", "ain", "name"), ("2/0", "***\n", "name"), ("2/0", "pl", "name")], {"1/0": "down"}), batch=1, passes=1, **NAP)
    assert {r.other: (r.text, r._status) for r in endless.where("other < 'c'").collect()} == {"a": (f"id {'*' * 7} and {'*' * 7}", "failed"), "b": ("*****", "unverified")}
    stars = documents.deidentify(spark.createDataFrame([(1, "***\nx")], "doc_id long, text string"), 1, detector=detectors.ScriptedDetector([("1/0", "***\n", "name")]), **NAP)
    assert tuple(stars.first()) == (1, "***\nx", "clean")

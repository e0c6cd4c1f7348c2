"""A directory of mixed files, end to end, and again."""

import io
import json
import shutil
import zipfile

import numpy as np
import pandas as pd
from larkspur.functions import dates
from larkspur.operators import adapters, audio, media, paths
from larkspur.operators.detectors import RuleDetector
from larkspur.plans import pipeline
from larkspur.sources import files, office, shared
from larkspur.sources import pixels as px
from pyspark.sql import functions as F


def put(root, name, data):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data if isinstance(data, bytes) else data.encode())


def docx(*texts):
    buf = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts)
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return buf.getvalue()


def test_directory(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    put(root, "patient_10000001/n.txt", "Seen 2140-09-25, mail a.b@c.example.com")
    put(root, "patient_10000001/t.csv", 'subject_id,note\n77,"on 2140-09-25, call +1 (017) 555-7713"\n78,\n')
    put(root, "patient_10000001/w.xlsx", office.write_xlsx({"S": (["id", "v"], [["5", "x 2140-09-25"]]), "E": (["h"], [])}))
    put(root, "patient_10000002/d.docx", docx("On 2140-09-25 from 97.51.17.173", "plain"))
    put(root, "top.txt", "")
    put(root, "bad.txt", b"\xff\xfe")
    put(root, "scan.png", b"x")
    put(root, "patient_10000002/.hidden/x.txt", "no")
    done = {r.input_path: r for r in pipeline.deidentify_directory(spark, str(root), str(out), "salt", sleep=lambda s: None).collect()}
    assert {k for k, r in done.items() if not r.success} == {"bad.txt", "scan.png"} and "backend" in done["scan.png"].error
    days = {p: spark.range(1).select(dates.subject_offset(F.lit(p), "salt").alias("d"), dates.shift(F.lit("2140-09-25"), dates.subject_offset(F.lit(p), "salt")).alias("s")).first().s for p in ("patient_10000001", "patient_10000002")}
    read = lambda name: open(done[name].output_path, "rb").read()
    one = days["patient_10000001"]
    assert read("patient_10000001/n.txt").decode() == f"Seen {one}, mail {'*' * 17}"
    assert read("patient_10000001/t.csv").decode() == f'subject_id,note\n**,"on {one}, call {"*" * 17}"\n**,\n'
    assert office.read_xlsx(read("patient_10000001/w.xlsx")) == {"S": (["id", "v"], [["*", f"x {one}"]]), "E": (["h"], [])}
    assert [t for _, _, t in office.read_docx(read("patient_10000002/d.docx"))] == [f"On {days['patient_10000002']} from {'*' * 12}", "plain"]
    assert read("top.txt") == b"" and "patient_ID_001" in done["patient_10000001/n.txt"].output_path
    # Again: what is done stays done; a changed file is done anew under the same alias.
    put(root, "patient_10000001/n.txt", "changed")
    again = {r.input_path: r for r in pipeline.deidentify_directory(spark, str(root), str(out), "salt", audit=True, sleep=lambda s: None).collect()}
    assert json.loads(open(again["patient_10000001/n.txt"].output_path.replace(".txt", "_debug.json")).read())["status"] == "clean"
    assert set(again) == {"patient_10000001/n.txt", "bad.txt", "scan.png"}
    assert again["patient_10000001/n.txt"].output_path == done["patient_10000001/n.txt"].output_path and read("patient_10000001/n.txt") == b"changed"


def test_adapters(spark):
    files = spark.createDataFrame([("a", bytearray(b"xy")), ("b", bytearray(b""))], "path string, content binary")
    sizes = lambda: lambda data: [{"n": len(data)}] if data else (_ for _ in ()).throw(ValueError("empty"))
    got = {r.path: (r.n, r.error) for r in adapters.apply(files, sizes, "path", "content", "n long").collect()}
    assert got == {"a": (2, None), "b": (None, "ValueError: empty")}
    got = adapters.apply(files, adapters.missing("ocr"), "path", "content", "text string").collect()
    assert all(r.text is None and "BackendMissing" in r.error for r in got)


def reading(places):
    """Reads `places` of an image unless they are all of one value."""

    def read(p):
        return [{"text": t, "x": x, "y": y, "width": w, "height": h, "confidence": 0.9} for t, x, y, w, h in places if np.ptp(p[y : y + h, x : x + w]) > 0]

    return read


class Names:
    """Knows one name, and fails on another."""

    batch = 1

    def detect(self, units):
        if units["text"].str.contains("broken").any():
            raise RuntimeError("no answer")
        rows = [(u, c, "jane", "name") for u, c, t in zip(units["unit"], units["col"], units["text"]) if "jane" in (t or "")]
        return pd.DataFrame(rows, columns=["unit", "col", "text", "type"])


class Busy:
    """Fails on its first calls for one text as a service does that is busy."""

    def __init__(self, path, times):
        self.path, self.times = path, times

    def detect(self, units):
        out = RuleDetector().detect(units)
        if units["text"].str.contains("later").any() and len(list(self.path.iterdir())) < self.times:
            (self.path / str(len(list(self.path.iterdir())))).touch()
            raise RuntimeError("503 service unavailable")
        return out

    batch = 1


def test_directory_with_backends(spark, tmp_path):
    root, out, calls = tmp_path / "in", tmp_path / "out", tmp_path / "calls"
    calls.mkdir()
    image = np.random.default_rng(1).integers(1, 200, (40, 60, 3)).astype(np.uint8)
    put(root, "p_10000001/scan 20240102.png", px.write_png(image))
    scan = px.new_dicom(image[..., 0].astype(np.uint16) * 9, {"PatientName": "Doe", "StudyDate": "21400925", "StudyInstanceUID": "1.2.3", "Modality": "CT", "StudyDescription": "of 2140-09-25, id 1234567"})
    put(root, "p_10000001/i.dcm", px.write_dicom(scan))
    put(root, "p_10000001/talk.wav", audio.to_wav(np.zeros(audio.RATE)))
    put(root, "jane/t.csv", "alpha,beta\nsecret,on 2140-09-25\nhidden,\n")
    put(root, "jane/broken.txt", "later")
    backends = media.Backends(ocr=reading([("12345678", 5, 5, 20, 10)]), transcribe=lambda s, r: "on 2140-09-25 call 0171234567", speak=lambda t: np.full(50, 0.2, np.float32))
    go = lambda **k: {r.input_path: r for r in pipeline.deidentify_directory(spark, str(root), str(out), "salt", Busy(calls, 2), backends=backends, columns=lambda names, rows: [c for c in names if rows and rows[0][c] == "secret"], names=Names(), tries=1, sleep=lambda s: None, **k).collect()}
    done = go()
    assert not {k: r.error for k, r in done.items() if not r.success}
    read = lambda name: open(done[name].output_path, "rb").read()
    moved = {p: spark.range(1).select(dates.shift(F.lit("2140-09-25"), dates.subject_offset(F.lit(p), "salt")).alias("s")).first().s for p in ("p_10000001", "jane")}
    new = px.read_png(read("p_10000001/scan 20240102.png"))
    assert (new[:20, :30] == 0).all() and (new[20:] == image[20:]).all()
    d = px.read_dicom(read("p_10000001/i.dcm"))
    tags, day = d.tags(), moved["p_10000001"]
    assert tags["PatientName"] == "" and tags["StudyDate"] == day.replace("-", "") and tags["StudyInstanceUID"].startswith("2.25.") and tags["Modality"] == "CT"
    assert tags["StudyDescription"] == f"of {day}, id *******" and d.pixels()[8, 8] == d.pixels().min() and (d.pixels()[20:] == scan.pixels()[20:]).all()
    assert len(audio.from_wav(read("p_10000001/talk.wav"))[0]) == 50 + len(audio.beep())
    assert read("jane/t.csv").decode() == f"alpha,beta\n******,on {moved['jane']}\n******,\n"
    # The busy service is asked again in later rounds.
    assert done["jane/broken.txt"].retries_attempted >= 1 and json.loads(done["p_10000001/i.dcm"].report)["texts"] == 1
    assert done["jane/broken.txt"].output_path.endswith("NAME/anonymized_broken_0001.txt")
    assert done["p_10000001/scan 20240102.png"].output_path.endswith("p_ID_001/scan DATE_0001.png")
    assert (out / "folder_anonymization.csv").read_text() == "original_foldername,anonymized_foldername,phi_values,phi_categories\njane,NAME,jane,NAME\np_10000001,p_ID_001,10000001,ID\n"
    assert "scan 20240102.png,scan DATE_0001.png,20240102,DATE" in (out / "p_ID_001/filename_anonymization.csv").read_text()
    # Without its tables a run goes on from the mapping files; what is there is skipped.
    shutil.rmtree(out / "_tables")
    put(root, "p_10000002/x.txt", "new")
    put(root, "jane/t2.csv", "a\nb\n")
    again = go(skip_existing=True)
    assert {k for k, r in again.items() if r.status == "skipped"} == set(done) and again["jane/t.csv"].output_path == done["jane/t.csv"].output_path
    assert again["p_10000002/x.txt"].output_path.endswith("p_ID_002/x_0001.txt") and again["jane/t2.csv"].output_path.endswith("NAME/t2_0001.csv")


def test_one_file_and_a_broken_state(spark, tmp_path):
    put(tmp_path, "in/n_1000001.txt", "mail a.b@c.example.com")
    one = files.scan(spark, str(tmp_path / "in/n_1000001.txt")).collect()
    assert [(r.path, r.kind, r.length) for r in one] == [("n_1000001.txt", "text", 22)]
    out = tmp_path / "out"
    go = lambda: pipeline.deidentify_directory(spark, str(tmp_path / "in/n_1000001.txt"), str(out), "s", sleep=lambda s: None).collect()
    assert [(r.input_path, r.success) for r in go()] == [("n_1000001.txt", True)] and go() == []
    (state,) = [v for v in (out / "_tables").iterdir() if v.name == "v2"]
    for f in state.rglob("*.parquet"):
        f.write_bytes(b"not a table at all")
    for f in state.rglob(".*.crc"):
        f.unlink()
    assert [r.success for r in go()] == [True]


def test_versions_survive_a_lost_writer(spark, tmp_path):
    v = shared.Versions(spark, str(tmp_path), "b")
    one = spark.createDataFrame([(1,)], "x int")
    assert v.read("a", "x int").count() == 0
    v.write({"b": one, "a": one})
    one.selectExpr("x + 1 as x").write.parquet(str(tmp_path / "v2/a"))  # and then the writer is lost
    assert [r.x for r in v.read("a", "x int").collect()] == [1] and v.numbers() == [1]
    for n in (5, 6, 7):
        v.write({"b": one, "a": one.selectExpr(f"{n} as x")})
    assert [r.x for r in v.read("a", "x int").collect()] == [7] and v.numbers() == [3, 4]
    shared.replace_current(spark, str(tmp_path / "c"), one)
    shared.replace_current(spark, str(tmp_path / "c"), shared.read_current(spark, str(tmp_path / "c"), "x int").selectExpr("x + 1 as x"))
    assert [r.x for r in shared.read_current(spark, str(tmp_path / "c"), "x int").collect()] == [2]
    shutil.move(tmp_path / "c/current", tmp_path / "c/next")
    assert [r.x for r in shared.read_current(spark, str(tmp_path / "c"), "x int").collect()] == [2]
    shared.replace_current(spark, str(tmp_path / "c"), shared.read_current(spark, str(tmp_path / "c"), "x int").selectExpr("x + 1 as x"))
    assert [r.x for r in spark.read.parquet(str(tmp_path / "c/current")).collect()] == [3]


def test_hot_names_are_numbered_in_ranges(spark):
    f = spark.range(400).selectExpr("'a' as folder", "concat('x_', lpad(id + 1000000, 9, '0'), '.txt') as name")
    got = sorted((r.name, r.counter) for r in paths.alias_files(f).collect())
    assert [c for _, c in got] == list(range(1, 401))


def test_columns_are_asked_once_a_table(spark, tmp_path):
    cells = [(f"{n}.csv", "", r, k, h, f"{r}{h}") for n in range(40) for k, h in enumerate("aba") for r in (10, 3, 1, 0, 2, -1, 4)]
    u = spark.createDataFrame(cells + [("x", pipeline.PIXELS, -1, 0, None, None)], "path string, part string, row long, col int, column string, value string")
    log = str(tmp_path / "asked")

    def tell(names, rows):
        with open(log, "a") as f:
            f.write(json.dumps([names, rows]) + "\n")
        return ["b", "a", "none"]

    told = pipeline.told_columns(u, tell)
    assert told.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    (tmp_path / "asked").unlink(missing_ok=True)
    assert sorted(map(tuple, told.collect())) == sorted((f"{n}.csv", "", h) for n in range(40) for h in "ab")
    asked = [json.loads(x) for x in open(log)]
    assert asked == [[list("aba"), [{"a": f"{r}a", "b": f"{r}b"} for r in range(5)]]] * 40


def test_units_of_many_files_share_a_batch(spark, monkeypatch):
    files_ = spark.createDataFrame([(f"{k}.txt", "text", b"x" * k) for k in range(300)] + [("bad.txt", "text", b"\xff"), ("none.txt", "text", None)], "path string, kind string, content binary").coalesce(1)
    made = []
    monkeypatch.setattr(type(files_), "mapInArrow", lambda self, run, schema: made.append(run) or self)
    pipeline.units(files_)
    monkeypatch.undo()
    got = list(made[0](iter(files_.toArrow().to_batches())))
    rows = [r for b in got for r in b.to_pylist()]
    assert len(got) == 1 and len(rows) == 302 and all(r["value"] == "x" * k for k, r in enumerate(rows[:300]))
    assert "UnicodeDecodeError" in rows[300]["error"] and "TypeError" in rows[301]["error"]

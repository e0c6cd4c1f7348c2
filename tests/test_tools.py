"""Prompts, answers and the tools that models call."""

from types import SimpleNamespace

import pytest
from larkspur.functions import dates
from larkspur.operators import prompts, state, tools
from larkspur.operators.detectors import detect
from larkspur.sources import files, office
from larkspur.sources import pixels as px
from pyspark.sql import functions as F

VALUES = [
    "2140-09-25", "2024-2-29", "2140-09-25T07:05:09", "2140-09-25T07:05:09.25", "2140-09-25 07:05:09", "2140-09-25 7:05", "2140-09-25 07:05 PM", "2140-09-25 07:05:03AM", "25.09.2140", "25.9.2140 7:05",
    "25/09/2140", "09/25/2140", "9-25-2140", "September 5, 2140", "Sep 5, 2140", "5 September 2140", "5 Sep 2140", "May 3, 2024", "07:05:09", "7:05", "2024", "2019-2021", "2019 – 2021", "no date", "2024-13-40", "31.02.2024",
]


@pytest.mark.parametrize("days", [400, -731])
def test_tool_and_column_agree(spark, days):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string").select("v", dates.shift(F.col("v"), days).alias("s"))
    for r in df.collect():
        assert tools.shift_datetime(r.v, days) == (r.s if r.s is not None else r.v + tools.FAILED), r.v


def test_tools_are_called_and_applied(spark):
    t = tools.Tools(400)
    assert t.call("redact_text", {"text": "Jane"}) == "****" and "FAILED" in t.call("redact_text", {"text": " "}) and "FAILED" in t.call("redact_column", {"column": ""})
    assert t.call("shift_datetime", {"value": "2140-09-25"}) == "2141-10-30" and t.call("shift_datetime", {"value": "soon"}) == "soon [SHIFT_FAILED]"
    assert t.call("redact_column", {"column": "name", "reason": "names"}).startswith("[REDACT") and t.columns == ["name"]
    assert t.call("fly", {}).startswith("Error") and t.call("redact_text", {"no": 1}).startswith("Error")
    assert t.applied("Jane on 2140-09-25, soon") == "**** on 2141-10-30, soon" and {s["name"] for s in t.specs()} == {"shift_datetime", "redact_text", "redact_column"}

    def converse(prompt, own):
        if "Jane" in prompt:
            own.call("redact_text", {"text": "Jane"})
            own.call("redact_text", {"text": "not there"})

    u = spark.createDataFrame([("1", "", "so Jane came"), ("2", "", "nobody")], "unit string, col string, text string")
    assert [(r.unit, r.text) for r in detect(u, tools.ToolDetector(converse)).collect()] == [("1", "Jane")]


def test_prompts():
    p = prompts.Prompts({"text": "Look at {text}"}, " be brief ")
    assert p.missing() == {} and p.render("text", text="x") == "Look at x\n\nAdditional Instructions:\nbe brief"
    assert prompts.Prompts({"text": "Look", "columns": "{rows}"}).missing() == {"text": ["text"], "columns": ["columns"]}
    q = prompts.Prompts.from_dict({**p.to_dict(), "unknown": "x", "image": ""})
    assert q.to_dict() == p.to_dict() and set(prompts.REQUIRED) == set(prompts.DEFAULTS)
    with pytest.raises(KeyError):
        prompts.Prompts({"nothing": "x"})


def test_answers():
    r = SimpleNamespace(content="<think>hm</think> yes ", additional_kwargs={})
    assert prompts.answer_of(r) == "yes" and prompts.reasoning_of(r) == "hm"
    r = {"content": [{"text": "a"}, "b"], "additional_kwargs": {"reasoning_content": "because"}}
    assert prompts.answer_of(r) == "ab" and prompts.reasoning_of(r) == "because" and prompts.answer_of("<think>x</think>") == "<think>x</think>"
    answers = iter(["no", "still [not json", 'so: {"a": [1]} ok'])
    seen = []
    assert prompts.ask_json(lambda p: (seen.append(p), next(answers))[1], "ask") == {"a": [1]} and seen[0] == "ask" and "JSON only" in seen[2]
    with pytest.raises(ValueError):
        prompts.ask_json(lambda p: "none", "ask")


def test_probe_preview_and_reports(spark, tmp_path):
    import numpy as np

    (tmp_path / "a.dcm").write_bytes(px.write_dicom(px.new_dicom(np.zeros((3, 4, 5), np.uint8), {"Modality": "US"})))
    (tmp_path / "b.dcm").write_bytes(b"broken")
    (tmp_path / "c.JPG").write_bytes(b"ab")
    (tmp_path / "d.xyz").write_bytes(b"z")
    scan = files.scan(spark, str(tmp_path))
    got = {r.path: r for r in files.probe(scan).collect()}
    assert (got["a.dcm"].frames, got["a.dcm"].rows, got["a.dcm"].is_video, got["a.dcm"].modality) == (3, 4, True, "US")
    assert got["b.dcm"].error and not got["d.xyz"].supported and got["c.JPG"].kind == "image" and not got["c.JPG"].is_video
    assert [r.p for r in scan.where("path = 'c.JPG'").select(files.image_preview(F.col("path"), F.col("content")).alias("p")).collect()] == ["data:image/jpeg;base64,YWI="]
    assert [r.path for r in files.listing(spark, str(tmp_path)).collect()] == ["a.dcm", "b.dcm", "c.JPG", "d.xyz"]
    res = spark.createDataFrame([(f"f{k:02d}", k % 2 == 0, "e") for k in range(30)], "input_path string, success boolean, error string")
    assert [r.input_path for r in state.first_failed(res).collect()] == [f"f{k:02d}" for k in range(1, 21, 2)]
    side = files.sidecars(res.limit(1).withColumn("to", F.lit("x/n_1.txt"))).collect()
    assert side[0].path == "x/n_1_debug.json" and b'"input_path":"f00"' in bytes(side[0].content)
    assert office.display({"S": (["a", "b"], [["1", "2"]]), "E": ([], [])}) == "=== Sheet: S ===\na | b\n1 | 2\n\n=== Sheet: E ==="

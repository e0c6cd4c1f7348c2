"""Images, DICOM files, sound and their flows, with scripted backends."""

import json
import struct
import zlib

import numpy as np
import pytest
from larkspur.operators import audio, media
from larkspur.operators.detectors import RuleDetector
from larkspur.plans import catalog
from larkspur.sources import pixels as px


@pytest.mark.parametrize("shape,kind", [((7, 5), np.uint8), ((4, 6, 3), np.uint8), ((3, 3, 4), np.uint8), ((5, 2, 2), np.uint8), ((6, 4), np.uint16), ((2, 3, 3), np.uint16)])
def test_png_round_trip(shape, kind):
    a = np.random.default_rng(1).integers(0, np.iinfo(kind).max + 1, shape).astype(kind)
    b = px.read_png(px.write_png(a))
    assert b.dtype == a.dtype and (a == b).all()


def filtered(a, kind):
    """Lines of 8-bit pixels under one filter, by the definition."""
    h, w, c = a.shape
    at = lambda y, x, k: int(a[y, x, k]) if y >= 0 and x >= 0 else 0
    out = []
    for y in range(h):
        out.append(kind)
        for x in range(w):
            for k in range(c):
                l, u, d = at(y, x - 1, k), at(y - 1, x, k), at(y - 1, x - 1, k)  # noqa: E741
                p = l + u - d
                paeth = l if abs(p - l) <= abs(p - u) and abs(p - l) <= abs(p - d) else u if abs(p - u) <= abs(p - d) else d
                out.append((int(a[y, x, k]) - [0, l, u, (l + u) // 2, paeth][kind]) % 256)
    return bytes(out)


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    a = np.random.default_rng(kind).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    head = struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)
    data = px._PNG + px._chunk(b"IHDR", head) + px._chunk(b"IDAT", zlib.compress(filtered(a, kind))) + px._chunk(b"IEND", b"")
    assert (px.read_png(data) == a).all()


def test_png_palette_and_bits():
    head = struct.pack(">IIBBBBB", 5, 1, 1, 0, 0, 0, 0)
    data = px._PNG + px._chunk(b"IHDR", head) + px._chunk(b"IDAT", zlib.compress(bytes([0, 0b10110000]))) + px._chunk(b"IEND", b"")
    assert px.read_png(data).tolist() == [[255, 0, 255, 255, 0]]
    head = struct.pack(">IIBBBBB", 2, 1, 4, 3, 0, 0, 0)
    data = px._PNG + px._chunk(b"IHDR", head) + px._chunk(b"PLTE", bytes(range(9))) + px._chunk(b"IDAT", zlib.compress(bytes([0, 0x21]))) + px._chunk(b"IEND", b"")
    assert px.read_png(data).tolist() == [[[6, 7, 8], [3, 4, 5]]]
    with pytest.raises(ValueError):
        px.read_png(b"GIF89a")


@pytest.mark.parametrize("syntax", [px.EXPLICIT, px.IMPLICIT, px.BIG])
@pytest.mark.parametrize("shape,kind", [((8, 6), np.uint16), ((3, 4, 5), np.int16), ((4, 4, 3), np.uint8), ((2, 4, 4, 3), np.uint8)])
def test_dicom_round_trip(syntax, shape, kind):
    a = np.random.default_rng(2).integers(0, 200, shape).astype(kind)
    d = px.new_dicom(a, {"PatientName": "Doe^Jane", "StudyDate": "20240102", "Modality": "CT", "SOPInstanceUID": "1.2.3"}, syntax)
    data = px.write_dicom(d)
    for raw in (data, data[: 128 + 4][:0] + data[132 + struct.unpack_from("<I", data, 140)[0] + 12 :]):  # with meta data, and probed without
        e = px.read_dicom(raw)
        assert e.syntax == syntax and e.shape() == shape and (e.pixels() == a).all()
        assert e.tags()["PatientName"] == "Doe^Jane" and e.tags()["Rows"] == str(shape[-3 if shape[-1] == 3 else -2])
    new = px.read_dicom(px.write_dicom(e.rewritten({"PatientName": "", "StudyDate": "20230101"}, a + 1, "changed")))
    assert (new.pixels() == a + 1).all() and new.pixels().dtype.itemsize == a.dtype.itemsize
    assert (new.tags()["PatientName"], new.tags()["StudyDate"], new.tags()["ImageComments"]) == ("", "20230101", "changed")
    assert "(0010,0010) PN PatientName: Doe^Jane" in d.dump()


def test_dicom_sequences_and_refusals():
    item = b"\x10\x00\x20\x00LO\x02\x00X1"
    seq = b"\xfe\xff\x00\xe0\xff\xff\xff\xff" + item + b"\xfe\xff\x0d\xe0\x00\x00\x00\x00" + b"\xfe\xff\xdd\xe0\x00\x00\x00\x00"
    base = px.new_dicom(np.zeros((2, 2), np.uint8), {})
    raw = px.write_dicom(base)
    cut = raw.index(b"\x28\x00\x02\x00")
    with_seq = raw[:cut] + b"\x10\x00\x02\x10SQ\x00\x00\xff\xff\xff\xff" + seq + raw[cut:]
    d = px.read_dicom(with_seq)
    again = px.read_dicom(px.write_dicom(d))
    assert [v for t, _, v in again.elements if t == 0x00101002] == [seq[:-8]]
    assert [v for t, _, v in d.rewritten({"OtherPatientIDsSequence": ""}).elements if t == 0x00101002] == [b""]
    with pytest.raises(NotImplementedError):
        px.read_dicom(raw.replace(px.EXPLICIT.encode() + b"\0", b"1.2.840.10008.1.2.5\0"))
    with pytest.raises(ValueError):
        px.read_dicom(b"nothing of the kind, really")


def test_pdf_of_pages():
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    data = px.write_pdf([a, np.zeros((2, 2, 3), np.uint8)])
    assert data.startswith(b"%PDF-1.4") and data.count(b"/Type /Page ") == 2 and zlib.compress(a.tobytes()) in data
    start = int(data.split(b"startxref\n")[1].split()[0])
    assert data[start:].startswith(b"xref") and all(data[int(x[:10]) :].startswith(b"%d 0 obj" % k) for k, x in enumerate(data[start:].split(b"\n")[3:11], 1))


READINGS = [("MRN 12345678", 10, 10, 80, 12), ("mail a.b@c.example.com", 10, 40, 120, 12), ("Kidney left", 10, 70, 60, 12)]


def reader(extra=(), scale=1):
    """Reads what is written in a place unless it is all of one value."""

    def read(p):
        return [{"text": t, "x": x, "y": y, "width": w, "height": h, "confidence": 0.9} for t, x, y, w, h in [*READINGS, *extra] if np.ptp(p[y : y + h, x : x + w]) > 0]

    return read


def picture(colour=False, kind=np.uint8):
    a = np.random.default_rng(3).integers(1, 200, (128, 160, 3) if colour else (128, 160)).astype(kind)
    return a


def test_image_is_redacted_and_checked():
    a = picture(True)
    b = media.Backends(ocr=reader(), faces=lambda p: [{"x": 100, "y": 90, "width": 35, "height": 35, "confidence": 0.9}, {"x": 0, "y": 100, "width": 20, "height": 20, "confidence": 0.9}])
    data, report = media.redact_image(px.write_png(a), b)
    out = px.read_png(data)
    assert (report.texts, report.faces, report.rounds, report.clean) == (2, [1], 0, True)
    hidden = np.zeros((128, 160), bool)
    for x, y, w, h, pad in ((10, 10, 80, 12, 5), (10, 40, 120, 12, 5), (100, 90, 35, 35, 10)):
        hidden[max(0, y - pad) : y + h + pad, max(0, x - pad) : x + w + pad] = True
    assert (out[hidden] == 0).all() and (out[~hidden] == a[~hidden]).all()


def test_checks_find_more_and_stop():
    a = picture(True)
    calls = []

    def pii(p, texts):
        calls.append(len(texts))
        # The first look misses one; checks name it with a letter misread.
        names = ["MRN 12345678"] if len(calls) == 1 else ["mail a.b@c.exampIe.com"] if np.ptp(p[40:52, 10:130]) > 0 else []
        return "text: " + ", type: id_number\ntext: ".join(names) + ", type: id_number" if names else "nothing"

    data, report = media.redact_image(px.write_png(a), media.Backends(ocr=reader(), pii=pii))
    assert (report.texts, report.checked, report.rounds, report.clean) == (1, 1, 1, True)
    # What can't be placed stays unverified.
    _, report = media.redact_image(px.write_png(a), media.Backends(ocr=reader(), pii=lambda p, t: [{"text": "zzzzzzzz", "type": "name"}]))
    assert not report.clean and report.unplaced == 1 and report.rounds == 0
    # Always something new: the rounds end.
    n = iter(range(9))
    more = media.Backends(ocr=lambda p: [{"text": "abcdef", "x": 5 * next(n), "y": 5, "width": 40, "height": 20, "confidence": 1.0}], pii=lambda p, t: [{"text": "abcdef", "type": "name"}])
    _, report = media.redact_image(px.write_png(a), more)
    assert report.rounds == 2 and not report.clean
    with pytest.raises(RuntimeError, match="backend for ocr"):
        media.redact_image(px.write_png(a), media.Backends())


def test_handwriting_takes_what_is_left():
    a = picture(True)
    state = {"n": 0}

    def pii(p, texts):
        state["n"] += 1
        return [{"text": "Jane Doe", "type": "name"}] if np.ptp(p[0:96, 0:160]) > 0 else []

    b = media.Backends(ocr=reader(), pii=pii, handwriting=lambda crop: "Jane Do" if crop.shape[0] == 96 and crop.shape[1] == 160 else "")
    _, report = media.redact_image(px.write_png(a), b)
    assert report.checked >= 1 and report.rounds >= 1


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_dicom_frames(kind):
    frames = np.stack([picture(kind=kind) * 3 if kind is np.uint16 else picture() for _ in range(3)])
    d = px.new_dicom(frames, {"PatientName": "Doe^Jane", "Modality": "US", "SeriesDescription": "left kidney"})
    b = media.Backends(ocr=reader(), head_scan=lambda p: "I think YES", deface=lambda p: np.where(np.arange(256)[:, None, None] < 8, 0.0, 1.0) * np.ones((1, 256, 3)))
    data, report = media.redact_dicom(px.write_dicom(d), {"PatientName": ""}, b)
    e = px.read_dicom(data)
    out = e.pixels()
    low = frames.min()
    assert out.dtype.itemsize == frames.dtype.itemsize and (out[:, 10:22, 10:90] == low).all() and (out[:, 40:52, 10:130] == low).all()
    assert (out[:, :4] == low).all() and (out[:, 100:] == frames[:, 100:]).all()
    assert (report.head_scan, report.defaced, report.faces, report.clean) == (True, 3, [0, 0, 0], True)
    assert e.tags()["PatientName"] == "" and e.tags()["ImageComments"] == "De-identified"
    no = media.Backends(ocr=reader(), head_scan=lambda p: 1 / 0, deface=lambda p: 1 / 0)
    assert media.redact_dicom(px.write_dicom(d), {}, no)[1].head_scan is False


def test_pages_video_and_sound():
    pages = [picture(True), picture()]
    b = media.Backends(
        ocr=reader(), pdf_pages=lambda data: pages, video_frames=lambda data: ([picture(True)] * 2, 25.0), video_save=lambda f, fps: f"{len(f)} at {fps}".encode(),
        transcribe=lambda s, rate: f"{len(s) / rate:.0f} s, call 0171234567", speak=lambda t: np.full(100 * len(t), 0.25, np.float32),
    )
    data, report = media.redact_pdf(b"%PDF", b)
    assert data.count(b"/Type /Page ") == 2 and report.texts == 4 and report.clean and json.loads(report.json())["hidden"] == 4
    assert media.redact_video(b"", b)[0] == b"2 at 25.0"
    wav = audio.to_wav(np.zeros(2 * audio.RATE))
    assert media.transcript(wav, b) == "2 s, call 0171234567"
    samples, _ = audio.from_wav(media.spoken("call ********** now", b))
    assert len(samples) == 400 + len(audio.beep()) + 300 and abs(samples[:400] - 0.25).max() < 1e-3


def test_rules_need_no_frames(monkeypatch):
    b = media.Backends()
    want = [{"text": "12345678", "type": "id_number"}]
    monkeypatch.setattr(media.pd, "DataFrame", None)  # one a reading took most of a file's time
    assert media.private_texts(None, ["id 12345678", "plain", None], b, RuleDetector()) == want
    monkeypatch.undo()

    class Names(RuleDetector):
        def detect(self, units):
            return units.assign(type="name")

    assert [i["text"] for i in media.private_texts(None, ["Ann", " "], b, Names())] == ["Ann"]


@pytest.mark.parametrize("name", ["dicom_redaction", "image_redaction"])
def test_files_are_rendered_on_all_cores(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

"""Images, frames and sound: finding, hiding and checking again, with injected
models.

All is done on one file's arrays at a time, in whatever task the file has come
to; the models are plain calls, made once per worker by whoever passes them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd

from ..functions.geometry import WINDOWS
from . import audio, vision
from .adapters import BackendMissing
from .detectors import Detector, RuleDetector, parse_items


@dataclass
class Backends:
    """Calls of models and codecs, None where there is none. `ocr` gives rows of
    text, x, y, width, height and confidence; `pii` items of text and type, or an
    answer in which they are looked for; `faces` rows of a box and confidence;
    `deface` a 256 x 256 array of channels; `head_scan` a yes or no in words."""

    ocr: Callable[[np.ndarray], list[dict]] | None = None
    pii: Callable[[np.ndarray, list[str]], list[dict] | str] | None = None
    faces: Callable[[np.ndarray], list[dict]] | None = None
    handwriting: Callable[[np.ndarray], str] | None = None
    head_scan: Callable[[np.ndarray], str] | None = None
    deface: Callable[[np.ndarray], np.ndarray] | None = None
    image_open: Callable[[bytes], np.ndarray] | None = None
    image_save: Callable[[np.ndarray], bytes] | None = None
    pdf_pages: Callable[[bytes], list[np.ndarray]] | None = None
    video_frames: Callable[[bytes], tuple[list[np.ndarray], float]] | None = None
    video_save: Callable[[list[np.ndarray], float], bytes] | None = None
    audio_open: Callable[[bytes], tuple[np.ndarray, int]] | None = None
    transcribe: Callable[[np.ndarray, int], str] | None = None
    speak: Callable[[str], np.ndarray] | None = None

    def need(self, name: str) -> Callable:
        call = getattr(self, name)
        if call is None:
            raise BackendMissing(f"no backend for {name}")
        return call


@dataclass
class Report:
    """What was hidden, for the audit record of a file. Texts are not in it."""

    faces: list[int] = field(default_factory=list)  # of every frame
    texts: int = 0
    checked: int = 0  # boxes that checks added
    rounds: int = 0
    unplaced: int = 0
    head_scan: bool = False
    defaced: int = 0
    clean: bool = False

    def json(self) -> str:
        return json.dumps(asdict(self) | {"faces_total": sum(self.faces), "frames": len(self.faces), "hidden": self.texts + self.checked + sum(self.faces)}, sort_keys=True)


def private_texts(pixels: np.ndarray, texts: list[str], b: Backends, detector: Detector) -> list[dict]:
    """Items of text and type on an image: a vision model's, read from its
    structure or, failing that, from its words; without one a detector's in the
    texts read."""
    if b.pii is not None:
        got = b.pii(pixels, texts)
        items = parse_items(got) if isinstance(got, str) else got
        return [i for i in items if str(i["text"]).strip()]
    if type(detector).detect is RuleDetector.detect:  # a frame costs many times what the rules do
        return [{"text": t, "type": k} for s in texts for t, k in detector.found(s or "") if t.strip("* ")]
    units = pd.DataFrame({"unit": [str(k) for k in range(len(texts))], "col": "", "text": texts})
    got = detector.detect(units) if len(units) else pd.DataFrame({"text": [], "type": []})
    return [{"text": t, "type": k} for t, k in zip(got["text"], got["type"]) if str(t).strip("* ")]


def _box(r: dict) -> tuple[int, int, int, int]:
    return int(r["x"]), int(r["y"]), int(r["width"]), int(r["height"])


def scan_handwriting(pixels: np.ndarray, read: Callable[[np.ndarray], str], windows=WINDOWS, least_chars: int = 2) -> list[dict]:
    """Readings of half-overlapping windows, and of a small image as a whole,
    without repeats; the reader tells no confidence, so all have 0.8."""
    h, w = pixels.shape[:2]
    places = [(x, y, min(ww, w - x), min(wh, h - y)) for wh, ww in windows for x in range(0, max(w, 1), ww // 2) for y in range(0, max(h, 1), wh // 2)]
    places = [p for p in places if p[2] >= 32 and p[3] >= 16]
    if w <= 800 and h <= 200:
        places.append((0, 0, w, h))
    rows = [(read(pixels[y : y + bh, x : x + bw]), x, y, bw, bh, 0.8) for x, y, bw, bh in places]
    found = pd.DataFrame([r for r in rows if len((r[0] or "").strip()) >= least_chars], columns=vision.OCR)
    return vision.suppress(found).to_dict("records") if len(found) else []


def _remaining(pixels: np.ndarray, wanted: list[str], seen: list[dict], b: Backends, least: float) -> tuple[list[tuple], int]:
    """Boxes of texts that a check still found, and how many have none: the first
    reading that fits, else one of the handwriting, one to one."""
    boxes, rest = [], []
    for t in wanted:
        fit = next((r for r in seen if vision.match_score(t, r["text"], least) > 0), None)
        boxes += [_box(fit)] if fit else []
        rest += [] if fit else [t]
    if rest and b.handwriting is not None:
        hand = scan_handwriting(pixels, b.handwriting)
        got = vision.greedy_match(rest, [r["text"] for r in hand], max(0.45, least - 0.1))
        boxes += [_box(hand[k]) for k in got if k is not None]
        rest = [t for t, k in zip(rest, got) if k is None]
    return boxes, len(rest)


def hide_private(frames: np.ndarray, b: Backends, detector: Detector | None = None, photometric: str = "RGB", rounds: int = 2, least: float = 0.6) -> tuple[np.ndarray, Report]:
    """Frames (n, h, w[, 3]) with personal data hidden. Texts of the first frame
    are hidden on all, faces on each; then the first frame is read again, and what
    is still found is hidden, `rounds` times at most. `clean` says that the last
    reading found nothing."""
    detector, report = detector or RuleDetector(), Report()
    read = b.need("ocr")
    first = vision.display(frames[0], photometric)
    seen = read(first)
    wanted = [i["text"] for i in private_texts(first, [r["text"] for r in seen], b, detector)]
    got = vision.greedy_match(wanted, [r["text"] for r in seen], least)
    boxes = [_box(seen[k]) for k in got if k is not None]
    report.texts = len(boxes)
    black = vision.fill_value(photometric, frames)
    out = vision.hide_boxes(frames, boxes, 5, black)
    report.faces = [0] * len(out)
    if b.faces is not None:
        for k in range(len(out)):
            found = [_box(r) for r in b.faces(vision.display(out[k], photometric)) if min(r["width"], r["height"]) >= 30 and r["confidence"] >= 0.5]
            report.faces[k] = len(found)
            out[k] = vision.hide_boxes(out[k], found, 10, black)
    if b.head_scan is not None and b.deface is not None:
        report.head_scan = _says_yes(b.head_scan, first)
        if report.head_scan:
            for k in range(len(out)):
                out[k] = vision.apply_mask(out[k], vision.defacing_mask(b.deface(vision.display(out[k], photometric))), black)
                report.defaced += 1
    for n in range(rounds + 1):
        now = vision.display(out[0], photometric)
        seen = read(now)
        wanted = [i["text"] for i in private_texts(now, [r["text"] for r in seen], b, detector)]
        if not wanted:
            report.clean = True
            break
        if n == rounds:
            break
        boxes, report.unplaced = _remaining(now, wanted, seen, b, least)
        if not boxes:
            break
        report.rounds, report.checked = n + 1, report.checked + len(boxes)
        out = vision.hide_boxes(out, boxes, 5, black)
    return out, report


def _says_yes(ask: Callable[[np.ndarray], str], first: np.ndarray) -> bool:
    """The last yes or no of an answer; an error, or neither, is a no."""
    import re

    try:
        found = re.findall(r"(?<![A-Z])(YES|NO)(?![A-Z])", str(ask(first)).upper())
    except Exception:
        return False
    return bool(found) and found[-1] == "YES"


def redact_image(data: bytes, b: Backends, detector: Detector | None = None, **settings) -> tuple[bytes, Report]:
    """An image file as one: PNG here, other kinds by `image_open` and `image_save`."""
    from ..sources import pixels as px

    png = data[:8] == px._PNG
    p = px.read_png(data) if png else b.need("image_open")(data)
    kind = "RGB" if p.ndim == 3 and p.shape[2] >= 3 else "MONOCHROME2"
    flat = p[..., 0] if p.ndim == 3 and p.shape[2] == 2 else p
    alpha = p[..., 3:] if p.ndim == 3 and p.shape[2] == 4 else p[..., 1:] if p.ndim == 3 and p.shape[2] == 2 else None
    out, report = hide_private((flat[..., :3] if flat.ndim == 3 else flat)[None], b, detector, kind, **settings)
    out = out[0]
    if alpha is not None:
        out = np.concatenate([out if out.ndim == 3 else out[..., None], alpha], -1)
    return (px.write_png(out) if png else b.need("image_save")(out)), report


def redact_dicom(data: bytes, tags: dict[str, str], b: Backends, detector: Detector | None = None, note: str = "De-identified", **settings) -> tuple[bytes, Report]:
    """A DICOM file with new tags and its pixels redacted at their full depth."""
    from ..sources import pixels as px

    d = px.read_dicom(data)
    old, p = d.tags(), d.pixels()
    colour = int(old.get("SamplesPerPixel") or 1) > 1
    frames = p if p.ndim == 3 + colour else p[None]
    out, report = hide_private(frames, b, detector, old.get("PhotometricInterpretation", "MONOCHROME2"), **settings)
    return px.write_dicom(d.rewritten(tags, out.reshape(p.shape), note)), report


def _merged(reports: list[Report]) -> Report:
    out = Report(clean=all(r.clean for r in reports))
    for r in reports:
        out.faces += r.faces
        out.texts, out.checked, out.unplaced, out.defaced = out.texts + r.texts, out.checked + r.checked, out.unplaced + r.unplaced, out.defaced + r.defaced
        out.rounds, out.head_scan = max(out.rounds, r.rounds), out.head_scan or r.head_scan
    return out


def redact_pdf(data: bytes, b: Backends, detector: Detector | None = None, dpi: int = 300, **settings) -> tuple[bytes, Report]:
    """A PDF as images of its pages, each redacted by itself."""
    from ..sources import pixels as px

    pages = [hide_private(p[None], b, detector, "RGB" if p.ndim == 3 else "MONOCHROME2", **settings) for p in b.need("pdf_pages")(data)]
    return px.write_pdf([p[0] for p, _ in pages], dpi), _merged([r for _, r in pages])


def redact_video(data: bytes, b: Backends, detector: Detector | None = None, **settings) -> tuple[bytes, Report]:
    frames, fps = b.need("video_frames")(data)
    out, report = hide_private(np.stack(frames), b, detector, "RGB", **settings)
    return b.need("video_save")(list(out), fps), report


def transcript(data: bytes, b: Backends) -> str:
    """What is said in a sound file: wav here, others by `audio_open`."""
    samples, rate = audio.from_wav(data) if data[:4] == b"RIFF" else b.need("audio_open")(data)
    return b.need("transcribe")(samples, rate)


def spoken(text: str, b: Backends) -> bytes:
    """A redacted transcript as a wav file, with a tone for every starred part."""
    steps, at = [], 0
    import re

    for m in re.finditer(r"\*{2,}", text):
        steps += [("speech", text[at : m.start()].strip()), ("beep", m[0])]
        at = m.end()
    steps.append(("speech", text[at:].strip()))
    return audio.to_wav(audio.render([s for s in steps if s[1]], b.speak))


REDACT = {"image": redact_image, "pdf": redact_pdf, "video": redact_video}


def redact_files(files, b: Backends, detector: Detector | None = None, **settings):
    """Image, PDF and video files (path, kind, content): one row each with the
    new content, the report as JSON, and an error in place of both."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            rows = []
            for r in f.itertuples(index=False):
                try:
                    data, report = REDACT[r.kind](bytes(r.content), b, detector, **settings)
                    rows.append((r.path, data, report.json(), None))
                except Exception as e:
                    rows.append((r.path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "content", "report", "error"])

    return files.select("path", "kind", "content").mapInPandas(run, "path string, content binary, report string, error string")

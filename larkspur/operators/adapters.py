"""Places for models and codecs that do not come with the library.

An adapter is a callable from one file's bytes (or array) to rows. It is made
once per Python worker by its factory, applied per Arrow batch, and an error
becomes a column of the row rather than the end of the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: What each is given and gives back.
KINDS = {
    "ocr": "pixels -> (text, x, y, width, height, confidence)", "handwriting": "pixels of a crop -> (text, confidence)", "faces": "pixels -> (x, y, width, height, confidence)",
    "deface": "pixels of a slice -> mask", "head_scan": "pixels -> answer", "vision_pii": "pixels, texts -> (text, type)", "transcribe": "sound -> text", "speak": "text -> samples",
    "pdf_pages": "pdf -> pixels of each page", "image_open": "image -> pixels", "image_save": "pixels -> image", "dicom_open": "dicom -> (tags, shape, dtype, pixels)", "dicom_save": "the same -> dicom",
    "video_frames": "video -> (frame_idx, pixels)", "video_save": "frames -> video", "audio_convert": "sound -> sound",
}


class BackendMissing(RuntimeError):
    """No backend is installed for an adapter."""


def missing(kind: str) -> Callable[[], Callable]:
    """The factory used where none is given."""
    if kind not in KINDS:
        raise KeyError(kind)

    def factory() -> Callable:
        def call(*_: object) -> list[dict]:
            raise BackendMissing(f"no backend for {kind} ({KINDS[kind]})")

        return call

    return factory


def apply(files: DataFrame, factory: Callable[[], Callable], key: str, value: str, schema: str) -> DataFrame:
    """Rows of `schema` (without key and error) for every (key, value) of
    `files`, one at least: a failed call gives its error and nulls."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        for f in frames:
            out = []
            for k, v in zip(f[key], f[value]):
                try:
                    got = list(call(v))
                    out += [{key: k, "error": None, **r} for r in got]
                except Exception as e:
                    out.append({key: k, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[key, *names, "error"]).astype(object).where(lambda d: d.notna(), None)

    kind = dict(files.dtypes)[key]
    return files.select(key, value).mapInPandas(run, f"{key} {kind}, {schema}, error string")

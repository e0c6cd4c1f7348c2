"""Transcripts with censored parts, and the sound put in their place."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 24000


def beep(ms: int = 300, hertz: int = 1000, rate: int = RATE, fade_ms: int = 10) -> np.ndarray:
    """A sine at half amplitude, faded in and out."""
    n, f = rate * ms // 1000, rate * fade_ms // 1000
    out = 0.5 * np.sin(2 * np.pi * hertz * (np.arange(n) / rate))
    if 0 < 2 * f < n:
        ramp = np.arange(f) / (f - 1) if f > 1 else np.zeros(1)
        out[:f] *= ramp
        out[n - f :] *= ramp[::-1]
    return out.astype(np.float32)


def plan(transcript: Column) -> Column:
    """What is said and what is beeped, in order: structs of kind and text. Two
    asterisks or more are a beep; blank speech is left out."""
    pieces = F.split(F.regexp_replace(transcript, r"(\*{2,})", "\u0001$1\u0001"), "\u0001")
    kinds = F.transform(pieces, lambda x: F.struct(F.when(x.rlike(r"^\*{2,}$"), "beep").otherwise("speech").alias("kind"), F.trim(x).alias("text")))
    return F.filter(kinds, lambda x: x["text"] != "")


def render(steps: list[tuple[str, str]], speak: Callable[[str], np.ndarray] | None = None, rate: int = RATE) -> np.ndarray:
    """Samples of a plan; `speak` is a speech model's call, silence without one.
    Nothing to say gives a second of silence."""
    voice = speak or (lambda t: np.zeros(rate * len(t.split()) // 3, np.float32))
    parts = [beep(rate=rate) if k == "beep" else voice(t) for k, t in steps]
    return np.concatenate(parts) if parts else np.zeros(rate, np.float32)


def to_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def from_wav(data: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(data)) as w:
        s = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32767
        return s.reshape(-1, w.getnchannels()).mean(1), w.getframerate()

"""Detectors of personal data behind one small interface.

A detector is called in a Python worker with a pandas frame of units (unit, col,
text) and returns a frame (unit, col, text, type): texts to hide, as they stand
in the unit. It may keep a model or a client, made once per worker. The default
is a deterministic set of rules and does not know names.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import RETRYABLE, RULES

#: What every match of a rule holds, where that is a fixed text.
NEEDED_BY = {RULES["email"]: "@", RULES["phone"]: "+1 ("}
FOUND = "unit string, col string, text string, type string, error string"


class Detector(Protocol):
    def detect(self, units: pd.DataFrame) -> pd.DataFrame: ...


class RuleDetector:
    """E-mail, telephone, card and IPv4 numbers, and runs of six digits."""

    batch = 4096

    def __init__(self, rules: dict[str, str] | None = None) -> None:
        self.rules = rules or {**RULES, "id_number": r"(?<![0-9])[0-9]{6,}(?![0-9])"}

    def found(self, text: str) -> list[tuple[str, str]]:
        """(text, type) of what one text holds, rule by rule."""
        taken: list[tuple[int, int]] = []
        out = []
        for kind, p in self.rules.items():
            if (need := NEEDED_BY.get(p)) and need not in text:
                continue
            for m in re.finditer(p, text):
                if all(m.end() <= a or m.start() >= z for a, z in taken):
                    taken.append(m.span())
                    out.append((m[0], kind))
        return out

    def detect(self, units: pd.DataFrame) -> pd.DataFrame:
        out = [(u, c, *x) for u, c, t in zip(units["unit"], units["col"], units["text"]) for x in self.found(t or "")]
        return pd.DataFrame(out, columns=["unit", "col", "text", "type"])


class ScriptedDetector:
    """Answers from a script of (unit, text, type), for tests; `error` is raised
    for units named there."""

    def __init__(self, script: list[tuple[str, str, str]], errors: dict[str, str] | None = None) -> None:
        self.script, self.errors = script, errors or {}

    def detect(self, units: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in units.itertuples(index=False):
            if str(r.unit) in self.errors:
                raise RuntimeError(self.errors[str(r.unit)])
            out += [(r.unit, r.col, t, k) for u, t, k in self.script if str(u) == str(r.unit)]
        return pd.DataFrame(out, columns=["unit", "col", "text", "type"])


class ModelDetector:
    """A language model asked per unit. `ask(prompt) -> answer` is the client's
    call; the answer is parsed leniently. No client comes with the library."""

    def __init__(self, ask: Callable[[str], str] | None = None, prompt: str = "List the personal data in:\n{text}") -> None:
        self.ask, self.prompt = ask, prompt

    def detect(self, units: pd.DataFrame) -> pd.DataFrame:
        if self.ask is None:
            raise NotImplementedError("no language model client is configured")
        out = []
        for r in units.itertuples(index=False):
            out += [(r.unit, r.col, i["text"], i["type"]) for i in parse_items(self.ask(self.prompt.format(text=r.text)))]
        return pd.DataFrame(out, columns=["unit", "col", "text", "type"])


def _without_thinking(s: str) -> str:
    t = re.sub(r"(?is)<think>.*?</think>|```think.*?```", "", s)
    t = re.sub(r"(?is)^.*</think>", "", t).strip()
    return t or s


_USUAL = {"dob": "date_of_birth", "mrn": "id_number", "patient_id": "id_number"}
_KNOWN = {*"address date_of_birth dates email id_number location name phone".split(), *_USUAL}


def _from_json(found: object) -> list[dict] | None:
    items = found.get("pii_texts") if isinstance(found, dict) else found
    if not isinstance(items, list):
        return None
    return [{"text": i["text"], "type": i["type"]} for i in items if isinstance(i, dict) and {"text", "type"} <= i.keys()]


def parse_items(answer: str) -> list[dict]:
    """Items of an answer: a JSON object or array in it, else text/type pairs,
    else a list of "kind: value" lines with known kinds."""
    answer = _without_thinking(answer)
    decoder = json.JSONDecoder(strict=False)
    for opening in "{[":
        for m in re.finditer(re.escape(opening), answer):
            try:
                items = _from_json(decoder.raw_decode(answer, m.start())[0])
            except ValueError:
                continue
            if items:
                return items
    bare = answer.replace("*", "")
    pairs = re.findall(r"""text\s*[:-]\s*["']?([^"'\n]+?)["']?\s*[,\n]?\s*type\s*[:-]\s*["']?([A-Za-z_]+)""", bare, re.I)
    if pairs:
        return [{"text": t.strip(), "type": k.lower()} for t, k in pairs if t.strip()]
    out = []
    for line in answer.splitlines():
        m = re.match(r"""\s*(?:\d+\.|[-*])\s*\**([A-Za-z_]+)\**\s*[:-]\s*\**\s*["']?([^"'\n,]+)""", line)
        if m and m[1].lower() in _KNOWN and m[2].strip():
            out.append({"text": m[2].strip(), "type": _USUAL.get(m[1].lower(), m[1].lower())})
    return out


def is_retryable(error: BaseException) -> bool:
    return isinstance(error, (TimeoutError, ConnectionError)) or any(p in str(error).lower() for p in RETRYABLE)


def delay(attempt: int, initial: float = 2.0, most: float = 60.0, base: float = 2.0, jitter: float = 0.25, after: float | None = None, rng: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt: exponential up to `most`, or what the
    service asked for, give or take `jitter`, at least `initial`."""
    d = min(after if after is not None else initial * base ** (attempt - 1), most)
    return max(initial, d * (1 + jitter * (2 * rng() - 1)))


def with_retry(call: Callable, tries: int = 5, sleep: Callable[[float], None] = time.sleep, **delays) -> object:
    for attempt in range(1, tries + 1):
        try:
            return call()
        except Exception as e:
            if attempt == tries or not is_retryable(e):
                raise
            after = getattr(e, "retry_after", None)
            sleep(delay(attempt, after=after, **delays))
    raise AssertionError("unreachable")


def found_in(units: pd.DataFrame, detector: Detector, batch: int | None = None, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> Iterator[pd.DataFrame]:
    """detect() on a frame of units, where that lies."""
    batch = batch or getattr(detector, "batch", 15)
    for lo in range(0, len(units), batch):
        part = units.iloc[lo : lo + batch]
        try:
            got = with_retry(lambda part=part: detector.detect(part), tries, sleep)
        except Exception as e:
            yield part[["unit", "col"]].assign(text=None, type=None, error=str(e))
            continue
        if not len(got):
            continue
        got = got.merge(part.rename(columns={"text": "_whole"}), on=["unit", "col"])
        ok = [bool(t and t.strip()) and t in (w or "") for t, w in zip(got["text"], got["_whole"])]
        yield got[ok][["unit", "col", "text", "type"]].assign(error=None)


def detect(units: DataFrame, detector: Detector, batch: int | None = None, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """FOUND rows for units (unit, col, text). Arrow batches are cut to `batch`
    units a call, by default the detector's own `batch` or 15. A call that fails leaves one row a unit with its error and no
    text, so that callers can fail closed; blank texts, and texts that don't
    stand in their unit, are dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield from found_in(f, detector, batch, tries, sleep)

    return units.select("unit", "col", "text").mapInPandas(run, FOUND)

"""Prompts as templates with required places, and reading what models answer."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from string import Formatter

#: The places that each prompt must have.
REQUIRED: dict[str, tuple[str, ...]] = {
    "columns": ("columns", "rows"), "cells": ("rows", "masked"), "cells_check": ("comparison", "days"), "text": ("text",), "text_check": ("original", "redacted", "days"),
    "image": ("texts",), "image_check": (), "tags": ("tags",), "transcript": ("text",), "transcript_check": ("original", "redacted", "days"), "name": ("name",), "head_scan": (), "kind": ("name", "preview"),
}
DEFAULTS: dict[str, str] = {
    "columns": "Which of these columns hold only personal data?\n{columns}\nFirst rows:\n{rows}\nAnswer with a JSON list of names.",
    "cells": "List the personal data in these rows as JSON objects of text and type; columns already masked: {masked}.\n{rows}",
    "cells_check": "Dates moved by {days} days. What personal data is left, as JSON objects of text and type?\n{comparison}",
    "text": "List the personal data in this text as JSON objects of text and type.\n{text}",
    "text_check": "Dates moved by {days} days. What personal data is left, as JSON objects of text and type?\nBefore:\n{original}\nAfter:\n{redacted}",
    "image": "Which of the texts read on this image are personal data? JSON objects of text and type.\n{texts}",
    "image_check": "What personal data can still be read on this image? JSON objects of text and type.",
    "tags": "List the personal data in these tags as JSON objects of text and type.\n{tags}",
    "transcript": "List the personal data in this transcript as JSON objects of text and type.\n{text}",
    "transcript_check": "Dates moved by {days} days. What personal data is left, as JSON objects of text and type?\nBefore:\n{original}\nAfter:\n{redacted}",
    "name": "List the personal data in this file name as JSON objects of text and type.\n{name}",
    "head_scan": "Does this image show a head so that a face could be made out? Answer YES or NO.",
    "kind": "What kind of file is this: video, image, pdf, text, csv, excel, docx, audio or dicom?\n{name}\n{preview}",
}


def places(template: str) -> set[str]:
    return {name for _, name, _, _ in Formatter().parse(template) if name}


class Prompts:
    """A set of prompts; what is not given is the default."""

    def __init__(self, own: dict[str, str] | None = None, instructions: str = "") -> None:
        unknown = set(own or {}) - set(DEFAULTS)
        if unknown:
            raise KeyError(f"no such prompt: {', '.join(sorted(unknown))}")
        self.templates, self.instructions = {**DEFAULTS, **(own or {})}, instructions

    def missing(self) -> dict[str, list[str]]:
        """The required places that prompts lack, for those that lack some."""
        lack = {k: sorted(set(REQUIRED[k]) - places(t)) for k, t in self.templates.items()}
        return {k: v for k, v in lack.items() if v}

    def render(self, name: str, **values: object) -> str:
        """A prompt with its places filled, and the user's instructions after it."""
        out = self.templates[name].format(**values)
        return f"{out}\n\nAdditional Instructions:\n{self.instructions.strip()}" if self.instructions.strip() else out

    def to_dict(self) -> dict[str, str]:
        return {**self.templates, "instructions": self.instructions}

    @classmethod
    def from_dict(cls, given: dict[str, str]) -> Prompts:
        """The reverse of to_dict(); entries that are no prompts are passed over."""
        return cls({k: v for k, v in given.items() if k in DEFAULTS and v}, given.get("instructions", ""))


_THINK = re.compile(r"(?is)<think>(.*?)</think>")


def answer_of(response: object) -> str:
    """What a client's response says, without its reasoning."""
    text = response.get("content", "") if isinstance(response, dict) else getattr(response, "content", response)
    if isinstance(text, list):
        text = "".join(p.get("text", "") if isinstance(p, dict) else str(p) for p in text)
    plain = re.sub(r"(?is)^.*</think>", "", re.sub(r"(?is)```think.*?```", "", _THINK.sub("", str(text or "")))).strip()
    return plain or str(text or "")


def reasoning_of(response: object) -> str:
    """The reasoning told beside an answer, or in it."""
    more = response.get("additional_kwargs", {}) if isinstance(response, dict) else getattr(response, "additional_kwargs", {})
    if more and more.get("reasoning_content"):
        return str(more["reasoning_content"])
    text = response.get("content", "") if isinstance(response, dict) else getattr(response, "content", "")
    return "\n".join(_THINK.findall(str(text or ""))).strip()


def json_in(answer: str) -> object:
    """The first JSON object or array in an answer that can be read; else None."""
    decoder, text = json.JSONDecoder(strict=False), answer_of(answer)
    for m in re.finditer(r"[{\[]", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def ask_json(ask: Callable[[str], object], prompt: str, tries: int = 3) -> object:
    """The JSON of a model's answer, asked again, with a word on the form, up to
    `tries` times in all; raises ValueError after the last."""
    for n in range(tries):
        found = json_in(answer_of(ask(prompt if not n else f"{prompt}\n\nAnswer with JSON only.")))
        if found is not None:
            return found
    raise ValueError(f"no JSON in {tries} answers")

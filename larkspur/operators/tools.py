"""Tools that a detector's model may call: a date moved, a text or column starred.

They are the Python twins of the column expressions in `functions`, for calls
that come one at a time from a model's loop.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta

from ..functions.dates import _RANGE, _YEAR, FORMATS

_READ = {"yyyy": "%Y", "MMMM": "%B", "MMM": "%b", "M": "%m", "d": "%d", "H": "%H", "h": "%I", "m": "%M", "s": "%S", "a": "%p", "'T'": "T", "[SSSSSS][SSSSS][SSSS][SSS][SS][S]": "%f"}
_WRITE = {"yyyy": "%Y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "dd": "%d", "HH": "%H", "hh": "%I", "mm": "%M", "ss": "%S", "a": "%p", "'T'": "T", "SSSSSS": "%f"}


def _translated(pattern: str, words: dict[str, str]) -> str:
    each = re.compile("|".join(map(re.escape, sorted(words, key=len, reverse=True))))
    return each.sub(lambda m: words[m[0]], pattern)


_FORMATS = tuple((re.compile(shape.replace(r"\d", "[0-9]")), _translated(read, _READ), _translated(write, _WRITE)) for shape, read, write in FORMATS)
FAILED = " [SHIFT_FAILED]"


def shift_datetime(value: str, days: int) -> str:
    """dates.shift() of one value; what is no date comes back with a mark."""
    s = re.sub(r"\s+", " ", value).strip(" ")
    if m := re.match(_RANGE.replace(r"\d", "[0-9]"), s):
        return f"{int(m[1]) + days // 365}{m[2]}{int(m[3]) + days // 365}"
    if re.match(_YEAR.replace(r"\d", "[0-9]"), s):
        return str(int(s) + days // 365)
    for shape, read, write in _FORMATS:
        if shape.match(s):
            try:
                out = datetime.strptime(s, read) + timedelta(days=days)
            except (ValueError, OverflowError):
                continue
            return out.strftime(write.replace("%Y", f"{out.year:04d}"))
    return f"{value}{FAILED}"


def redact_text(text: str) -> str:
    """As many asterisks as characters; a blank text is refused in words."""
    return "*" * len(text) if text.strip() else "[REDACT_FAILED: empty text]"


def redact_column(column: str, reason: str = "") -> str:
    """What a model is told of a column that is to be masked."""
    return f"[REDACT_COLUMN:{column}:{reason}]" if column.strip() else "[REDACT_COLUMN_FAILED: empty column name]"


class Tools:
    """The tools of one subject, called by name with a model's arguments. What is
    called is kept, so that the calls can be applied to the texts afterwards."""

    def __init__(self, days: int) -> None:
        self.days, self.replaced, self.columns = days, {}, []

    def specs(self) -> list[dict]:
        one = lambda name, what, args: {"name": name, "description": what, "parameters": {"type": "object", "properties": {a: {"type": "string"} for a in args}, "required": list(args)}}
        return [one("shift_datetime", "Move a date.", ("value",)), one("redact_text", "Star a text.", ("text",)), one("redact_column", "Mask a column.", ("column",))]

    def call(self, name: str, arguments: dict) -> str:
        """A tool's answer; a failed or unknown call is told to the model in words."""
        tools: dict[str, Callable[..., str]] = {"shift_datetime": self._shift, "redact_text": self._star, "redact_column": self._mask}
        try:
            return tools[name](**arguments)
        except (KeyError, TypeError) as e:
            return f"Error: {type(e).__name__}: {e}"

    def _shift(self, value: str) -> str:
        out = shift_datetime(value, self.days)
        if not out.endswith(FAILED):  # callers keep the original
            self.replaced[value] = out
        return out

    def _star(self, text: str) -> str:
        out = redact_text(text)
        if text.strip():
            self.replaced[text] = out
        return out

    def _mask(self, column: str, reason: str = "") -> str:
        self.columns += [column] if column.strip() else []
        return redact_column(column, reason)

    def applied(self, text: str) -> str:
        """A text with all that was called for, the longest first, in one pass."""
        if not self.replaced:
            return text
        each = "|".join(re.escape(k) for k in sorted(self.replaced, key=lambda k: (-len(k), k)))
        return re.sub(each, lambda m: self.replaced[m[0]], text)


class ToolDetector:
    """A model that works by tools: `converse(prompt, tools)` lets it call
    `tools.call()` as often as it likes; what it starred is what was found."""

    def __init__(self, converse: Callable[[str, Tools], object], prompt: str = "Star all personal data in:\n{text}", days: int = 0) -> None:
        self.converse, self.prompt, self.days = converse, prompt, days

    def detect(self, units):
        import pandas as pd

        out = []
        for r in units.itertuples(index=False):
            tools = Tools(self.days)
            self.converse(self.prompt.format(text=r.text), tools)
            out += [(r.unit, r.col, t, "personal") for t, new in tools.replaced.items() if set(new) == {"*"}]
        return pd.DataFrame(out, columns=["unit", "col", "text", "type"])

"""Dates inside text: finding them, and moving them by whole days in their own
spelling. Built-in functions only; sessions should run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import rewrite

_FULL = "|".join("January February March April May June July August September October November December".split())
_SHORT = "|".join("Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec".split())
_NAME = f"(?:{_FULL}|{_SHORT})"
_ISO = "[0-9]{4}(?:-[0-9]{2}){2}"
_CLOCK = "[0-9]{2}(?::[0-9]{2}){2}"
_POINTS, _SLASHES = r"(?:[0-9]{2}\.){2}[0-9]{4}", "(?:[0-9]{2}/){2}[0-9]{4}"
#: What counts as a date in running text, the longer spelling first.
PATTERN = rf"(?i)\b(?:{_ISO}[T\s]{_CLOCK}|{_ISO}\s+[0-9]{{1,2}}:[0-9]{{2}}\s*[ap]m|{_ISO}|{_POINTS}|{_SLASHES}|{_NAME}\s+[0-9]{{1,2}},?\s+[0-9]{{4}}|[0-9]{{1,2}}\s+{_NAME}\s+[0-9]{{4}})\b"
#: In transcripts clock times stay apart and months after the day are written out.
SPOKEN = rf"(?i)\b(?:{_ISO}[T\s]{_CLOCK}|{_ISO}|{_POINTS}|{_SLASHES}|{_NAME}\s+[0-9]{{1,2}},?\s+[0-9]{{4}}|[0-9]{{1,2}}\s+(?:{_FULL})\s+[0-9]{{4}})\b"

_CLOCKS = ("", " H:m:s", " H:m")
#: (shape, reading, writing), tried in this order; day first before month first.
FORMATS: tuple[tuple[str, str, str], ...] = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d", "yyyy-MM-dd"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", "yyyy-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", "yyyy-M-d H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", "yyyy-M-d H:m", "yyyy-MM-dd HH:mm"),
    *((rf"(?i)^\d{{4}}-\d{{1,2}}-\d{{1,2}} \d{{1,2}}:\d{{1,2}}{sec and ':[0-9]{1,2}'}{gap}[ap]m$", f"yyyy-M-d h:m{sec}{gap}a", f"yyyy-MM-dd hh:mm{sec and ':ss'}{gap}a") for sec in ("", ":s") for gap in ("", " ")),
    *((rf"^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}{c and ' [0-9:]+'}$", f"d.M.yyyy{c}", "dd.MM.yyyy" + c.replace("H", "HH").replace("m", "mm").replace("s", "ss")) for c in _CLOCKS),
    *(
        (rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}{c and ' [0-9:]+'}$", f"{x}/{y}/yyyy{c}", f"{x}{x}/{y}{y}/yyyy" + c.replace("H", "HH").replace("m", "mm").replace("s", "ss"))
        for x, y in ("dM", "Md")
        for c in _CLOCKS
    ),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy", "MM-dd-yyyy"),
    (rf"(?i)^(?:{_FULL}) \d{{1,2}}, \d{{4}}$", "MMMM d, yyyy", "MMMM dd, yyyy"),
    (rf"(?i)^(?:{_SHORT}|May) \d{{1,2}}, \d{{4}}$", "MMM d, yyyy", "MMM dd, yyyy"),
    (rf"(?i)^\d{{1,2}} (?:{_FULL}) \d{{4}}$", "d MMMM yyyy", "dd MMMM yyyy"),
    (rf"(?i)^\d{{1,2}} (?:{_SHORT}|May) \d{{4}}$", "d MMM yyyy", "dd MMM yyyy"),
    (r"^\d{1,2}:\d{1,2}:\d{1,2}$", "H:m:s", "HH:mm:ss"),
    (r"^\d{1,2}:\d{1,2}$", "H:m", "HH:mm"),
)
_YEAR, _RANGE = r"^\d{4}$", r"^(\d{4})(\s*[-–]\s*)(\d{4})$"


def found(c: Column, pattern: str = PATTERN) -> Column:
    """The distinct dates of a text, the longest first, then by themselves."""
    each = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1))
    return F.array_sort(each, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def _moved(s: Column, days: Column, shape: str, read: str, write: str) -> Column:
    ts = F.try_to_timestamp(s, F.lit(read))
    return F.when(s.rlike(shape), F.date_format(ts + F.make_dt_interval(days), write))


def shift(c: Column, days: Column | int, reading: str | None = None) -> Column:
    """A date, year or range of years moved by `days`; null if it is none. Years
    move by whole 365-day years, rounded down; a clock time stays itself. Where
    all values are known to have one format of FORMATS, `reading` names it and
    spares the search for it; values of other formats are then null."""
    days = F.lit(days) if isinstance(days, int) else days
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    if reading is not None:
        return _moved(s, days, *next(f for f in FORMATS if f[1] == reading))
    years = F.floor(days / 365)
    move = lambda y: (y.cast("int") + years).cast("string")
    span = F.concat(move(F.regexp_extract(s, _RANGE, 1)), F.regexp_extract(s, _RANGE, 2), move(F.regexp_extract(s, _RANGE, 3)))
    return F.coalesce(F.when(s.rlike(_RANGE), span), F.when(s.rlike(_YEAR), move(s)), *[_moved(s, days, *f) for f in FORMATS])


def shape(c: Column) -> Column:
    """Which format a date is read by: 'range', 'year' or the reading pattern."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    each = [F.when(s.rlike(p) & F.try_to_timestamp(s, F.lit(r)).isNotNull(), F.lit(r)) for p, r, _ in FORMATS]
    return F.coalesce(F.when(s.rlike(_RANGE), F.lit("range")), F.when(s.rlike(_YEAR), F.lit("year")), *each)


#: The formats that PATTERN can find.
_IN_TEXT = tuple(f for f in FORMATS if f[1] in ("yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d h:ma", "yyyy-M-d h:m a", "d.M.yyyy", "d/M/yyyy", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"))


def shift_token(x: Column, days: Column) -> Column:
    """One found date moved. Where a date with a clock time can't be read, its
    date part moves; what can't be read at all stays."""
    s = F.regexp_replace(x, r"\s+", " ")
    whole = F.coalesce(*[_moved(s, days, *f) for f in _IN_TEXT])
    head = F.when(x.rlike(rf"^{_ISO}.+"), F.concat(_moved(F.substring(x, 1, 10), days, *FORMATS[0]), F.substring(x, F.lit(11), F.length(x))))
    return F.coalesce(whole, head, x)


def shift_text(c: Column, days: Column | int, pattern: str = PATTERN) -> Column:
    """Every date of a text moved, in one pass, so none is moved twice."""
    days = F.lit(days) if isinstance(days, int) else days
    return rewrite(c, pattern, lambda x: shift_token(x, days), "[0-9]")


def shift_tag(c: Column, days: Column | int) -> Column:
    """A yyyyMMdd value moved; anything else stays."""
    days = F.lit(days) if isinstance(days, int) else days
    ts = F.when(c.rlike(r"^\d{8}$"), F.try_to_timestamp(c, F.lit("yyyyMMdd")))
    return F.coalesce(F.date_format(ts + F.make_dt_interval(days), "yyyyMMdd"), c)


def subject_offset(subject: Column, salt: str = "") -> Column:
    """Days by which all dates of one subject move: 365 to 1095, either way, the
    same in every run under the same salt."""
    h = F.sha2(F.concat(F.lit(salt), subject), 256)
    days = F.lit(365) + F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 731
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return (days * sign).cast("int")



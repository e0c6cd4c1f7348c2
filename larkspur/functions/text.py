"""Text expressions: redaction, masking, names, model answers. All built-in
functions, so they stay inside generated code and push down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns whose classes are ASCII and that use no word boundary, so that every
#: regex dialect reads them alike.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "ipv4": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "card": r"[0-9]{16}",
}
ANY_RULE = "|".join(RULES.values())
MARK = "\u0001"
#: What every match of a rule holds: a cheap test that most texts fail.
NEEDED = "[@0-9]"


def stars(c: Column) -> Column:
    """As many asterisks as the value has code points; blank gives ''."""
    return F.when(F.trim(c) == "", F.lit("")).otherwise(F.repeat(F.lit("*"), F.length(c)))


def mask(c: Column) -> Column:
    """A whole cell in asterisks; null and empty stay."""
    return F.when(c != "", F.repeat(F.lit("*"), F.length(c))).otherwise(c)


def is_open(c: Column) -> Column:
    """Whether a cell still holds something: not empty, not all asterisks."""
    return (c != "") & ~c.rlike(r"^\*+$")


def rewrite(c: Column, pattern: str, change, needed: str | None = None) -> Column:
    """Every match of `pattern` replaced by `change(match)` in one pass from left
    to right, so nothing is changed twice. `needed`, if given, matches something
    in every match, and spares the search in texts without it."""
    marked = F.regexp_replace(c, f"({pattern})", f"{MARK}$1{MARK}")
    parts = F.transform(F.split(marked, MARK), lambda x, i: F.when(i % 2 == 1, change(x)).otherwise(x))
    # A text that holds the mark itself is taken apart in two passes.
    matches = F.transform(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1), change)
    apart = F.zip_with(F.split(c, pattern, -1), matches, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    found = c.rlike(pattern) if needed is None else c.rlike(needed) & c.rlike(pattern)
    return F.when(found, F.when(F.contains(c, F.lit(MARK)), F.array_join(apart, "")).otherwise(F.array_join(parts, ""))).otherwise(c)


def _needed(pattern: str) -> str | None:
    return NEEDED if pattern == ANY_RULE or pattern in RULES.values() else None


def redact(c: Column, pattern: str = ANY_RULE) -> Column:
    """Matches in asterisks of their own length."""
    return rewrite(c, pattern, lambda x: F.repeat(F.lit("*"), F.length(x)), _needed(pattern))


def hits(c: Column, pattern: str = ANY_RULE) -> Column:
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)
    if _needed(pattern) is None:
        return found
    return F.when(c.isNull() | c.rlike(NEEDED), found).otherwise(F.array().cast("array<string>"))


def redact_literals(c: Column, literals: Column) -> Column:
    """Every given text starred wherever it occurs, the longest first."""
    longest = F.array_sort(
        F.array_distinct(F.filter(literals, lambda x: F.trim(x) != "")),
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0),
    )
    return F.aggregate(longest, c, lambda t, x: F.replace(t, x, F.repeat(F.lit("*"), F.length(x))))


def apply_map(c: Column, pairs: Column) -> Column:
    """An ordered list of (original, replacement) applied one after another."""
    return F.aggregate(pairs, c, lambda t, p: F.replace(t, p["original"], p["replacement"]))


def occurrences(c: Column, part: Column) -> Column:
    """How often `part` occurs, not overlapping."""
    return F.when(F.length(part) > 0, ((F.length(c) - F.length(F.replace(c, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


# Names and paths


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """From the last dot; a name that only begins with a dot has none."""
    return F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


IGNORED = ("desktop.ini", ".DS_Store", "thumbs.db", ".gitkeep", "Thumbs.db", ".gitignore", ".ds_store")


def is_system_file(path: Column) -> Column:
    return base_name(path).isin(*IGNORED)


def is_hidden(relative: Column) -> Column:
    """Any part of the relative path begins with a dot."""
    return F.exists(F.split(relative, "/"), lambda p: p.startswith("."))


def substitute_parts(path: Column, names: Column) -> Column:
    """Path parts replaced through a map; parts without an entry stay."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.coalesce(names[p], p)), "/")


ROUTES = (
    ("video", ("mp4", "avi", "mov", "mkv")), ("image", ("png", "jpg", "jpeg")), ("pdf", ("pdf",)), ("text", ("txt", "hea")),
    ("csv", ("csv",)), ("excel", ("xlsx", "xls")), ("docx", ("docx",)), ("audio", ("wav", "mp3")),
)


def route(name: Column, content: Column | None = None) -> Column:
    """The kind of processor for a file, the first that accepts it: DICOM by its
    extension or mark, then the others by extension; null if none does."""
    ext = F.lower(F.substring(extension(name), 2, 100))
    dicom = ext.isin("dcm", "dicom")
    if content is not None:
        dicom = dicom | (F.substring(content, 129, 4) == F.lit(b"DICM"))
    out = F.when(dicom, "dicom")
    for kind, exts in ROUTES:
        out = out.when(ext.isin(*exts), kind)
    return out


# Model answers


def strip_thinking(c: Column) -> Column:
    """Without reasoning: closed blocks in tags or fences, and everything up to
    an orphan end tag; what would be empty stays as it was."""
    t = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    t = F.regexp_replace(t, r"(?is)```think.*?```", "")
    t = F.trim(F.regexp_replace(t, r"(?is)^.*</think>", ""))
    return F.when(t == "", c).otherwise(t)


def json_object(c: Column) -> Column:
    """The outermost {...} of an answer, control characters removed; else null."""
    t = F.regexp_extract(strip_thinking(c), r"(?s)\{.*\}", 0)
    return F.when(t != "", F.regexp_replace(t, r"[\x00-\x1f]+", ""))


def last_yes_no(c: Column) -> Column:
    """True or false by the last YES or NO; neither gives false."""
    found = F.regexp_extract_all(F.upper(strip_thinking(c)), F.lit(r"(?:^|[^A-Z])(YES|NO)(?=[^A-Z]|$)"), 1)
    return F.coalesce(F.try_element_at(found, F.lit(-1)) == "YES", F.lit(False))


_KINDS = tuple("address date_of_birth dates email id_number location name phone".split())


def pii_type(c: Column) -> Column:
    """A known kind of personal data under its usual name; else null."""
    k = F.lower(F.trim(c))
    return F.when(k == "dob", "date_of_birth").when(k.isin("mrn", "patient_id"), "id_number").when(k.isin(*_KINDS), k)


RETRYABLE = (
    "429", "500", "502", "503", "bad gateway", "capacity", "connection", "overloaded", "rate limit", "rate_limit", "ratelimit", "server error",
    "service unavailable", "temporarily unavailable", "timed out", "timeout", "too many requests",
)


def is_retryable(error: Column) -> Column:
    return F.lower(error).rlike("|".join(RETRYABLE))


def backoff(attempt: Column, initial: float = 2.0, most: float = 60.0, base: float = 2.0) -> Column:
    """Seconds to wait before an attempt, without jitter."""
    return F.least(F.lit(initial) * F.pow(F.lit(base), attempt - 1), F.lit(most))

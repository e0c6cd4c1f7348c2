"""Format-preserving pseudonyms for personal numbers, dates and addresses.

What is found is validated (check digits, octets, calendar), taken as a number
in the domain of its format and permuted there under a key, so equal values get
equal pseudonyms in every document, other values other ones, and nothing but
the key is shared between tasks. The permutation is a Feistel network on the
domain's two mixed-radix halves with cycle walking. It is conjugated with a
keyed shift, x -> P^-1(P(x) + s), so no value is its own pseudonym, and can be
undone with the key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .durable import small_batches

ROUNDS = 8


class Cipher:
    """Keyed permutations of 0..n-1 for any n."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self._key, self._back = blake2b(key, digest_size=32).digest(), back

    def _mac(self, *parts: object) -> int:
        text = "|".join(map(str, parts)).encode()
        return int.from_bytes(blake2b(text, key=self._key, digest_size=64).digest(), "big")

    def _stretch(self, n: int, *parts: object) -> int:
        """A keyed number below n, however large."""
        x = 0
        for i in range(n.bit_length() // 448 + 1):
            x = x << 512 | self._mac(i, *parts)
        return x % n

    def _feistel(self, x: int, n: int, tweak: str, back: bool) -> int:
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)  # left below a, right below b
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if r % 2 == 0:
                    f = self._stretch(a, tweak, n, r, right)
                    left = (left - f if back else left + f) % a
                else:
                    f = self._stretch(b, tweak, n, r, left)
                    right = (right - f if back else right + f) % b
            x = left * b + right
            if x < n:  # else walk on along the cycle
                return x

    def permute(self, x: int, n: int, tweak: str) -> int:
        """Another number below n; with back=True the one that it came from."""
        if n < 2:
            return x
        s = 1 + self._stretch(n - 1, "shift", tweak, n)
        y = self._feistel(x, n, tweak, False)
        return self._feistel((y - s if self._back else y + s) % n, n, tweak, True)


def luhn(digits: str) -> int:
    """The check digit that follows `digits`."""
    t = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        t += x - 9 * (x > 9)
    return -t % 10


def _fill(shape: str, chars: str) -> str:
    """`shape` with its letters and digits replaced, in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _plain(s: str) -> str:
    return "".join(c for c in s if c.isalnum())


def card(s: str, c: Cipher) -> str | None:
    d = _plain(s)
    if luhn(d[:-1]) != int(d[-1]):
        return None
    p = str(c.permute(int(d[:-1]), 10 ** (len(d) - 1), "card")).zfill(len(d) - 1)
    return _fill(s, p + str(luhn(p)))


def ipv4(s: str, c: Cipher) -> str | None:
    o = [int(x) for x in s.split(".")]
    if max(o) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
        return None
    y = c.permute(int.from_bytes(bytes(o), "big"), 1 << 32, "ip")
    return ".".join(map(str, y.to_bytes(4, "big")))


def phone(s: str, c: Cipher) -> str | None:
    """Ten national digits; a country code stays."""
    keep = re.match(r"\+?1[ .-]?(?=\D?\d{3}\D)", s)
    head, rest = (s[: keep.end()], s[keep.end() :]) if keep else ("", s)
    d = _plain(rest)
    if len(d) != 10:
        return None
    return head + _fill(rest, str(c.permute(int(d), 10**10, "phone")).zfill(10))


def ssn(s: str, c: Cipher) -> str | None:
    a, g, n = (int(x) for x in s.split("-"))
    if a in (0, 666) or a >= 900 or not g or not n:
        return None
    x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1
    y, n = divmod(c.permute(x, 898 * 99 * 9999, "ssn"), 9999)
    a, g = divmod(y, 99)
    a += 1 + (a + 1 >= 666)
    return f"{a:03d}-{g + 1:02d}-{n + 1:04d}"


def _iban_number(s: str) -> int:
    return int("".join(str(int(x, 36)) for x in s[4:] + s[:4]))


def iban(s: str, c: Cipher) -> str | None:
    d = _plain(s)
    if not 15 <= len(d) <= 34 or _iban_number(d) % 97 != 1:
        return None
    body = classes(d[4:], c, "iban" + d[:2])
    check = 98 - _iban_number(d[:2] + "00" + body) % 97
    return _fill(s, f"{d[:2]}{check:02d}{body}")


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ")


def classes(s: str, c: Cipher, tweak: str) -> str:
    """Digits to digits, small to small letters, capitals to capitals, plain or
    accented; the rest stays."""
    sets = [next((k for k in _SETS if x in k), None) for x in s]
    x, n = 0, 1
    for ch, k in zip(s, sets):
        if k:
            x, n = x * len(k) + k.index(ch), n * len(k)
    y, out = c.permute(x, n, tweak + "".join("." if not k else k[0] for k in sets)), []
    for ch, k in zip(reversed(s), reversed(sets)):
        if k:
            y, i = divmod(y, len(k))
            ch = k[i]
        out.append(ch)
    return "".join(reversed(out))


def email(s: str, c: Cipher) -> str | None:
    """The part before the @; the domain stays."""
    local, _, domain = s.rpartition("@")
    return classes(local, c, "email@" + domain.lower()) + "@" + domain


MONTHS = tuple("January February March April May June July August September October November December".split())


def _shift_date(y: int, m: int, d: int, c: Cipher) -> date | None:
    """Another day of the same century."""
    try:
        day = date(y, m, d).toordinal()
    except ValueError:
        return None
    first = date(max(y - y % 100, 1), 1, 1).toordinal()
    n = date(y - y % 100 + 99, 12, 31).toordinal() - first + 1
    return date.fromordinal(first + c.permute(day - first, n, f"date{y // 100}"))


def iso_date(s: str, c: Cipher) -> str | None:
    sep = s[4]
    got = _shift_date(*map(int, s.split(sep)), c)
    return got and got.strftime(f"%Y{sep}%m{sep}%d").zfill(10)


def short_date(s: str, c: Cipher) -> str | None:
    """Day first, or month first where the day-first reading is no date."""
    sep = s[2]
    a, b, y = map(int, s.split(sep))
    if (got := _shift_date(y, b, a, c)) is not None:
        return f"{got.day:02d}{sep}{got.month:02d}{sep}{got.year:04d}"
    if sep != "." and (got := _shift_date(y, a, b, c)) is not None:
        return f"{got.month:02d}{sep}{got.day:02d}{sep}{got.year:04d}"
    return None


def named_date(s: str, c: Cipher) -> str | None:
    d, m, y = (int(re.search(p, s)[0]) if p != "[A-Za-z]+" else re.search(p, s)[0] for p in (r"(?<!\d)\d{1,2}(?!\d)", "[A-Za-z]+", r"\d{4}"))
    month = next((i for i, k in enumerate(MONTHS, 1) if m.lower() in (k.lower(), k[:3].lower())), None)
    got = month and _shift_date(y, month, d, c)
    if not got:
        return None
    name = MONTHS[got.month - 1]
    name = name if len(m) > 3 or m.lower() == "may" and s.find(",") > 0 else name[:3]
    out = re.sub(r"[A-Za-z]+", lambda _: name, s, count=1)
    out = re.sub(r"\d{4}", lambda _: f"{got.year:04d}", out)
    return re.sub(r"(?<!\d)\d{1,2}(?!\d)", lambda _: str(got.day), out, count=1)


_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS) + ")"
#: kind, pattern, pseudonym; the earlier pattern wins where two begin together.
KINDS: tuple[tuple[str, str, Callable[[str, Cipher], str | None]], ...] = (
    ("email", r"(?<!\w)\w[\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    ("iban", r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)", iban),
    ("iso_date", r"\d{4}([-/])\d{2}\1\d{2}", iso_date),
    ("short_date", r"\d{2}([-/.])\d{2}\1\d{4}", short_date),
    ("named_date", rf"(?:{_MONTH}\.? \d{{1,2}},? \d{{4}}|\d{{1,2}} {_MONTH}\.?,? \d{{4}})", named_date),
    ("ssn", r"\d{3}-\d{2}-\d{4}", ssn),
    ("card", r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})", card),
    ("ipv4", r"\d{1,3}(?:\.\d{1,3}){3}", ipv4),
    ("phone", r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", phone),
)


def _pattern() -> re.Pattern:
    parts, shift = [], 0
    for kind, p, _ in KINDS:
        # Back-references count groups from the start of the whole pattern.
        n = re.compile(p).groups
        p = re.sub(r"\\([12])", lambda m, base=shift + 1: f"\\{int(m[1]) + base}", p)
        parts.append(f"(?P<{kind}>{p})")
        shift += n + 1
    # The first characters keep the search from trying at every letter; an @
    # later in the same word is what an address needs. A clock time may follow
    # an iso_date.
    return re.compile(r"(?<![A-Za-z0-9_])(?=[0-9+(]|[A-Za-z]{2}\d|(?:" + "|".join(m[:3] for m in MONTHS) + r")|[\w.%+-]+@)(?<![0-9][.,-])(?:" + "|".join(parts) + r")(?:(?![A-Za-z0-9_]|[.-]\d)|(?<=\d{4}[-/]\d{2}[-/]\d{2})(?=T\d{2}:?\d{2}))")


PATTERN = _pattern()
_MAKE = {k: f for k, _, f in KINDS}
_HINT = tk._table((0x30, 0x39), (0x40, 0x40))


class Pseudonyms:
    def __init__(self, key: str, back: bool = False) -> None:
        self._cipher = Cipher(key.encode(), back)
        self._of = lru_cache(1 << 14)(lambda kind, s: _MAKE[kind](s, self._cipher))

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with its pseudonyms, and (kind, start, stop) of what they
        replaced."""
        spans: list[tuple[str, int, int]] = []

        def put(m: re.Match) -> str:
            new = self._of(m.lastgroup, m[0])
            if new is None:
                return m[0]
            spans.append((m.lastgroup, m.start(), m.end()))
            return new

        return PATTERN.sub(put, text), spans


def _run(key: str, back: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for b in batches:
            for lo, hi, buf, offs in tk.chunks(b.column(1)):
                # Only texts with a digit or an @ can hold anything.
                hint = np.concatenate([[0], np.cumsum(_HINT[buf])])
                some = np.flatnonzero(hint[offs[1:]] > hint[offs[:-1]])
                texts, spans = b.column(1).slice(lo, hi - lo), [[]] * (hi - lo)
                if len(some):
                    texts = texts.to_pylist()
                    for d in some:
                        texts[d], found = names.text(texts[d])
                        spans[d] = [{"kind": k, "start": s, "stop": e} for k, s, e in found]
                    texts = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), texts, pa.array(spans, kind)], ["doc_id", "text", "found"])

    return run


def pseudonymise(docs: DataFrame, key: str, back: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text with pseudonyms, found (kind, start and stop, in
    code points of the text given). `back` undoes it under the same key.

    Kinds: e-mail addresses (the part before the @), IBANs (mod 97), card
    numbers of 13 to 19 digits (Luhn), IPv4 addresses, telephone numbers of ten
    national digits, US social security numbers, and dates that exist, in six
    spellings, moved within their century. What fails its validation stays. A
    null text stays null, an empty one empty; ids may be null or repeat; each
    row is read whole and alone, so nothing is shuffled; an empty table gives no
    rows. Other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(
        _run(key, back), "doc_id long, text string, found array<struct<kind:string,start:int,stop:int>>"
    )


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """`documents`, under the key in spark.larkspur.pii.key."""
    key = spark.conf.get("spark.larkspur.pii.key", "larkspur")
    p = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), key)
    n = lambda *kinds: F.size(F.filter("found", lambda x: x["kind"].isin(*kinds))).cast("long")
    return p.select(
        "doc_id", "text", F.size("found").cast("long").alias("n_found"), n("email").alias("n_emails"), n("phone").alias("n_phones"), n("card", "iban", "ssn").alias("n_numbers"),
        n("ipv4").alias("n_ips"), n("iso_date", "short_date", "named_date").alias("n_dates"),
    )


QUERIES = {"op2_pii": op2_pii}
SQL: dict[str, str] = {}

"""Format-preserving pseudonyms of personal values in texts.

Values are found by one pattern, validated, and permuted within their format
by a keyed Feistel network, so that equal values get equal pseudonyms in all
documents and different values stay different:

- e-mail addresses: letters and digits of the local part and of all but the
  last two labels of the domain, each within its class;
- payment card numbers of 13 to 19 digits (Luhn): the digits before the check
  digit, which is computed anew; separators stay;
- IBANs (modulo 97): the digits and capitals behind the country code; the check
  digits are computed anew;
- phone numbers written (ddd) ddd-dddd or ddd-ddd-dddd, with or without a
  country code, which stays: the ten digits;
- other phone numbers: international ones (+ and 8 to 15 digits in groups), the
  digits behind the country code; French ones in pairs (0d dd dd dd dd) and
  Spanish ones in groups of three or two, within what their first digits allow;
- US social security numbers with valid area, group and serial: within these;
- IPv4 addresses with octets up to 255: the 32 bits;
- calendar dates from 1900 to 2099 written yyyy-mm-dd, dd/mm/yyyy, mm/dd/yyyy
  or dd.mm.yyyy: within the days of these two centuries (where day and month
  may be exchanged, the day is taken first);
- hexadecimal secrets of 32 digits or more that are assigned to a name like
  token, secret, password or api_key: their digits.

Whole texts are read in Arrow batches, without a shuffle.

Defined results: a null text stays null with no value replaced; texts without
values are unchanged; texts of any length are read whole; of kinds that match at
one place the first of the pattern is taken, so there are no ties; repeated rows give equal rows; a null doc_id stays null;
an empty table gives no rows; other columns are ignored (`pseudonymise_text`
keeps them as they are).
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util as U

#: The key of the registered query. Callers pass their own and keep it secret.
KEY = b"kmerloom demonstration key"
ROUNDS = 8
MEMO = 200_000

FIRST_DAY = datetime.date(1900, 1, 1)
DAYS = (datetime.date(2100, 1, 1) - FIRST_DAY).days

PATTERN = re.compile(
    r"""
      (?P<email> (?<![A-Za-z0-9._%+-]) [A-Za-z0-9._%+-]{1,64} @ [A-Za-z0-9-]{1,63} (?:\.[A-Za-z0-9-]{1,63})+ )
    | (?P<iban> \b [A-Z]{2}[0-9]{2} (?:[ ]?[A-Z0-9]{4}){2,7} (?:[ ]?[A-Z0-9]{1,3})? \b )
    | (?P<secret> (?<= [=:]) [ ]? ["']? [0-9A-Fa-f]{32,128} \b )
    | (?P<day> (?<![0-9./-]) (?: [0-9]{4}-[0-9]{2}-[0-9]{2} | [0-9]{2}/[0-9]{2}/[0-9]{4} | [0-9]{2}\.[0-9]{2}\.[0-9]{4} ) (?![0-9]|[./-][0-9]) )
    | (?P<ip> (?<![0-9.]) [0-9]{1,3} (?:\.[0-9]{1,3}){3} (?![0-9]|\.[0-9]) )
    | (?P<ssn> (?<![0-9-]) [0-9]{3}-[0-9]{2}-[0-9]{4} (?![0-9]|-[0-9]) )
    | (?P<phone> (?<![0-9-]) (?:\+[0-9]{1,3}[ .-]?)? (?: \([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4} | [0-9]{3}[.-][0-9]{3}[.-][0-9]{4} ) (?![0-9]|-[0-9]) )
    | (?P<abroad> (?<![0-9+]) \+[1-9][0-9]{0,2} (?: [ .-]? (?: \([0-9]{1,5}\) | [0-9]{2,5} ) ){2,6} (?![0-9]) )
    | (?P<national> (?<![0-9.-]) (?: 0[1-9](?:[ .-][0-9]{2}){4} | [6-9][0-9]{2}(?:[ -][0-9]{3}){2} | [6-9][0-9]{2}(?:[ ][0-9]{2}){3} ) (?![0-9]|[.-][0-9]) )
    | (?P<card> (?<![0-9-]) (?: [0-9]{13,19} | [0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7} | [0-9]{4}(?P<gap2>[ -])[0-9]{6}(?P=gap2)[0-9]{5} ) (?![0-9]|-[0-9]) )
    """,
    re.VERBOSE,
)
_ANY = re.compile(r"[0-9@]")
_NAMED = re.compile(r"(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|key)[\"']?\s*$", re.IGNORECASE)


#: Calling codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def feistel(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): rounds over two digits of a mixed radix, walked until inside."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8
    while True:
        left, right = divmod(x, b)
        for k in range(ROUNDS):
            if k % 2:
                f = hashlib.blake2b(b"%d|%b|" % (k, tweak) + left.to_bytes(width), key=key, digest_size=width + 8).digest()
                right = (right + int.from_bytes(f)) % b
            else:
                f = hashlib.blake2b(b"%d|%b|" % (k, tweak) + right.to_bytes(width), key=key, digest_size=width + 8).digest()
                left = (left + int.from_bytes(f)) % a
        x = left * b + right
        if x < size:
            return x


def luhn_digit(digits: str) -> int:
    """The check digit behind `digits`."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def iban_remainder(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


class Pseudonyms:
    """Pseudonyms of values; remembers a bounded number of them."""

    def __init__(self, key: bytes):
        self.key, self.known = hashlib.blake2b(key, digest_size=32).digest(), {}

    def _permute(self, x: int, size: int, kind: str) -> int:
        return feistel(x, size, self.key, f"{kind}|{size}".encode())

    def _classes(self, s: str, kind: str) -> str:
        """Letters and digits permuted together, each within its class; other characters stay."""
        spans = [(10, "0") if "0" <= c <= "9" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (0, "") for c in s]
        x, size = 0, 1
        for c, (n, zero) in zip(s, spans, strict=True):
            if n:
                x, size = x * n + ord(c) - ord(zero), size * n
        x = self._permute(x, size, kind + "|" + "".join(z or c for c, (_, z) in zip(s, spans, strict=True)))
        out = []
        for c, (n, zero) in zip(reversed(s), reversed(spans), strict=True):
            if n:
                x, d = divmod(x, n)
                c = chr(ord(zero) + d)
            out.append(c)
        return "".join(reversed(out))

    def _digits(self, s: str, kind: str) -> str:
        """The digits of s permuted, all else kept."""
        digits = re.sub(r"[^0-9]", "", s)
        return self._fill(s, f"{self._permute(int(digits), 10 ** len(digits), kind):0{len(digits)}d}")

    @staticmethod
    def _fill(s: str, chars: str) -> str:
        it = iter(chars)
        return re.sub(r"[0-9A-Z]", lambda _: next(it), s)

    def email(self, s: str) -> str:
        local, _, domain = s.partition("@")
        labels = domain.split(".")
        own, rest = ".".join(labels[:-2]), ".".join(labels[-2:])
        changed = self._classes(f"{local}@{own}" if own else local, "email")
        return f"{changed}.{rest}" if own else f"{changed}@{rest}"

    def card(self, s: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", s)
        if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        n = len(digits) - 1
        head = f"{self._permute(int(digits[:-1]), 10**n, 'card'):0{n}d}"
        return self._fill(s, head + str(luhn_digit(head)))

    def iban(self, s: str) -> str | None:
        flat = s.replace(" ", "")
        if not 15 <= len(flat) <= 34 or iban_remainder(flat) != 1:
            return None
        body = self._classes(flat[4:], "iban" + flat[:2])
        check = 98 - iban_remainder(flat[:2] + "00" + body)
        return self._fill(s, f"{flat[:2]}{check:02d}{body}")

    def phone(self, s: str) -> str:
        at = max(0, re.search(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[.-][0-9]{4}$", s).start())
        return s[:at] + self._digits(s[at:], "phone")

    def abroad(self, s: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", s)
        if not 8 <= len(digits) <= 15:
            return None
        n = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
        at = [m.end() for m in re.finditer("[0-9]", s)][n - 1]
        return s[:at] + self._digits(s[at:], "abroad" + digits[:n])

    def national(self, s: str) -> str:
        digits = re.sub(r"[^0-9]", "", s)
        first, least, kinds = (1, 1, 9) if digits[0] == "0" else (0, 6, 4)
        rest = len(digits) - first - 1
        x = self._permute((int(digits[first]) - least) * 10**rest + int(digits[first + 1 :]), kinds * 10**rest, "national")
        return self._fill(s, f"{digits[:first]}{x // 10**rest + least}{x % 10**rest:0{rest}d}")

    def ssn(self, s: str) -> str | None:
        area, group, serial = map(int, s.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self._permute(x, 898 * 99 * 9999, "ssn"), 9999)
        area, group = divmod(x, 99)
        area += 1 + (area + 1 >= 666)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def ip(self, s: str) -> str | None:
        octets = [int(x) for x in s.split(".")]
        if max(octets) > 255:
            return None
        x = self._permute(int.from_bytes(bytes(octets)), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4)))

    def day(self, s: str) -> str | None:
        mark = s[4] if s[4] == "-" else s[2]
        parts = [int(x) for x in s.split(mark)]
        orders = [("%Y-%m-%d", parts)] if mark == "-" else [(f"%d{mark}%m{mark}%Y", parts[::-1])]
        if mark == "/":
            orders.append(("%m/%d/%Y", [parts[2], parts[0], parts[1]]))
        for form, (y, m, d) in orders:
            try:
                n = (datetime.date(y, m, d) - FIRST_DAY).days
            except ValueError:
                continue
            if 0 <= n < DAYS:
                to = FIRST_DAY + datetime.timedelta(self._permute(n, DAYS, "day"))
                return to.strftime(form)
        return None

    def secret(self, s: str) -> str:
        lead = re.match(r" ?[\"']?", s)[0]
        body = s[len(lead) :]
        x = self._permute(int(body, 16), 16 ** len(body), "secret")
        out = f"{x:0{len(body)}x}"
        return lead + (out.upper() if body.upper() == body else out)

    def of(self, kind: str, s: str) -> str | None:
        """The pseudonym; None for a value that is not valid."""
        at = (kind, s)
        if at not in self.known:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[at] = getattr(self, kind)(s)
        return self.known[at]

    def rewrite(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each replaced value in the text given."""
        if not _ANY.search(text):
            return text, []
        out, spans, at, scan = [], [], 0, 0
        while m := PATTERN.search(text, scan):
            kind, s = m.lastgroup, m[0]
            new = None if kind == "secret" and not _NAMED.search(text, max(0, m.start() - 40), m.start() - 1) else self.of(kind, s)
            if new is None:  # not valid; another value may start within it
                scan = m.start() + 1
                continue
            out += [text[at : m.start()], new]
            spans.append((kind, *m.span()))
            at = scan = m.end()
        return ("".join(out) + text[at:], spans) if spans else (text, [])


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text with pseudonyms, and spans: kind, start and end (characters) of each value in the input text."""

    def run(batches):
        p = Pseudonyms(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            done = [(None, []) if t.as_py() is None else p.rewrite(t.as_py()) for t in b.column(1)]
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in found] for _, found in done]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(spans, kind)], ["doc_id", "text", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, spans array<struct<kind: string, start: int, end: int>>")


def pseudonymise_text(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """The same columns, with pseudonyms in text."""
    at = docs.columns.index("text")

    def run(batches):
        p = Pseudonyms(key)
        for b in batches:
            texts = [None if t.as_py() is None else p.rewrite(t.as_py())[0] for t in b.column(at)]
            yield b.set_column(at, b.schema.field(at).name, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced."""
    return pseudonymise(U.spread(U.table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "text", F.size("spans").cast("long").alias("n_replaced"))

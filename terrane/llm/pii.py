"""Format-preserving pseudonyms of personal data by a keyed Feistel permutation.

What a detector finds is validated (Luhn, mod 97, octets, calendar, numbering
plans) and stays if it is not valid; else it is taken to a
number within its format, permuted there under a key, and written back with the
same punctuation. A permutation keeps equal values equal in every document and
different values different, and pseudonyms are valid like the originals:
each format is a set of strings, permuted in itself. The key is the caller's; a
session without one (spark.terrane.pii.secret, a name that Spark blanks out in
its logs) gets a random one, so nobody can turn its pseudonyms back, and
pseudonyms are linked within that session only.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import secrets
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8, within

ROUNDS, KEY_SETTING = 8, "spark.terrane.pii.secret"
#: Country calling codes of one and of two digits; others have three.
CALLING_1, CALLING_2 = "1 7".split(), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

_FORM = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_|sk-)[A-Za-z0-9]{20,}|(?<![A-Za-z0-9])(?=[0-9a-f]*\d)[0-9a-f]{32,}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?=[0-9A-F]*\d)[0-9A-F]{32,}(?![A-Za-z0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4}(?![\w:]|\.\d))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"
    r"|(?P<ymd>(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-]))"
    r"|(?P<dmy>(?<![\d./])\d{1,2}(?P<sep>[./])\d{1,2}(?P=sep)\d{4}(?![\d/]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+.,/-])0[1-9]\d{0,3}[ /-]\d{3,4}(?:[ -]?\d{2,4}){1,2}(?![\w-]))"
    r"|(?P<number>(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w]))"
)
_MAY = re.compile(rb"[0-9@]")


def _round(key: bytes, tweak: bytes, i: int, half: int, bits: int) -> int:
    h = hashlib.blake2b(tweak + bytes([i]) + half.to_bytes((bits + 7) // 8 or 1, "big"), key=key[:64], digest_size=64)
    out, n = int.from_bytes(h.digest(), "big"), 512
    while n < bits:
        h.update(b"+")
        out, n = out << 512 | int.from_bytes(h.digest(), "big"), n + 512
    return out & (1 << bits) - 1


def permute(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of the numbers under size, or its inverse: Feistel rounds over the next even number of bits, again until the result is under size."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    tweak = hashlib.blake2b(tweak + size.to_bytes((size.bit_length() + 7) // 8, "big"), key=key[:64], digest_size=16).digest()
    while True:
        a, b = x >> half, x & (1 << half) - 1
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            a, b = (b ^ _round(key, tweak, i, a, half), a) if back else (b, a ^ _round(key, tweak, i, b, half))
        x = a << half | b
        if x < size:
            return x


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_RADIX = {c: s for s in _CLASSES for c in s}


def _mixed(text: str, radix: dict[str, str], key: bytes, tweak: bytes) -> str:
    """Characters permuted together, each within its own alphabet; those without one stay."""
    x, size = 0, 1
    for c in text:
        if c in radix:
            s = radix[c]
            x, size = x * len(s) + s.index(c), size * len(s)
    if size == 1:
        return text
    x, out = permute(x, size, key, tweak), []
    for c in reversed(text):
        if c in radix:
            s = radix[c]
            x, k = divmod(x, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out))


_DIGITS, _HEX = {c: _CLASSES[0] for c in _CLASSES[0]}, {c: "0123456789abcdef" for c in "0123456789abcdef"}


def _refill(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in form)


def luhn(digits: str) -> int:
    """The check digit that digits need."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _number(x: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", x)
    if luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = _mixed(digits[:-1], _DIGITS, key, b"card")
    return _refill(x, body + str(luhn(body)))


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _iban(x: str, key: bytes) -> str | None:
    plain = x.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, rest) != int(check):
        return None
    rest = _mixed(rest, _RADIX, key, b"iban" + country.encode())
    it = iter(f"{country}{_iban_check(country, rest):02d}{rest}")
    return "".join(c if c == " " else next(it) for c in x)


def _ip(x: str, key: bytes) -> str | None:
    parts = [int(p) for p in x.split(".")]
    if max(parts) > 255:
        return None
    n = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _ip6(x: str, key: bytes) -> str | None:
    """An address of 128 bits, with a digit and three groups at least (others are names in programs). Short forms stay short where zeros allow, capitals capitals."""
    try:
        n = int(ipaddress.IPv6Address(x))
    except ValueError:
        return None
    if not re.search(r"\d", x):
        return None
    new = str(ipaddress.IPv6Address(permute(n, 1 << 128, key, b"ip6")))
    return new.upper() if x.isupper() else new


#: Dates of recent centuries are permuted among each other, and all other dates among themselves.
_FIRST, _DAYS, _ALL = datetime.date(1900, 1, 1).toordinal(), 73049, datetime.date.max.toordinal()


def _day(y: int, m: int, d: int, key: bytes, fits: Callable[[datetime.date], bool]) -> datetime.date | None:
    """The pseudonym of a date among the dates of its time that fit, which the date itself does; None if it is no date."""
    try:
        n = datetime.date(y, m, d).toordinal()
    except ValueError:
        return None
    recent = 0 <= n - _FIRST < _DAYS
    while True:  # following a cycle to its next date that fits is one to one
        n = _FIRST + permute(n - _FIRST, _DAYS, key, b"date") if recent else 1 + permute(n - 1, _ALL, key, b"far date")
        day = datetime.date.fromordinal(n)
        if (recent or not 0 <= n - _FIRST < _DAYS) and fits(day):
            return day


def _ymd(x: str, key: bytes) -> str | None:
    day = _day(*map(int, x.split("-")), key, lambda _: True)
    return day and day.isoformat()


def _dmy(x: str, key: bytes) -> str | None:
    """Day first where that is a date, else month first. Month-first dates stay those that can't be read day first, and one digit stays one digit."""
    sep = "." if "." in x else "/"
    a, b, y = x.split(sep)
    swap = int(b) > 12 >= int(a)  # month first
    d, m = (b, a) if swap else (a, b)
    day = _day(int(y), int(m), int(d), key, lambda t: (t.day > 12 or not swap) and (t.day < 10 or len(d) > 1) and (t.month < 10 or len(m) > 1))
    if day is None:
        return None
    parts = {True: (day.month, day.day), False: (day.day, day.month)}[swap]
    return sep.join([*(f"{p:0{len(old)}d}" for p, old in zip(parts, (a, b))), f"{day.year:04d}"])


def _within(digits: str, key: bytes, tweak: bytes, valid: Callable[[str], bool]) -> str | None:
    """Valid digits permuted among those that are valid; None for others."""
    if not valid(digits):
        return None
    while True:
        digits = _mixed(digits, _DIGITS, key, tweak)
        if valid(digits):
            return digits


def _ssn(x: str, key: bytes) -> str | None:
    new = _within(re.sub(r"\D", "", x), key, b"ssn", lambda n: n[:3] not in ("000", "666") and n[0] != "9" and n[3:5] != "00" and n[5:] != "0000")
    return new and _refill(x, new)


def _phone(x: str, key: bytes) -> str | None:
    """The country's code stays, and has to be one. Numbers of North America's plan have ten digits, and area and exchange begin with 2
    to 9; others have 5 to 15 with their code. National numbers, 0 and an area first, have 9 to 12."""
    digits = re.sub(r"\D", "", x)
    code = (digits[:1] if digits[:1] in CALLING_1 else digits[:2] if digits[:2] in CALLING_2 else digits[:3]) if x[0] == "+" else ""
    rest = digits[len(code) :]
    if code == "1" or not code and x[0] != "0":
        new = _within(rest, key, b"phone1", lambda n: len(n) == 10 and n[0] > "1" and n[3] > "1")
    elif not code:
        new = _within(rest, key, b"national", lambda n: 9 <= len(n) <= 12 and n[0] == "0" and n[1] != "0")
    else:
        new = _mixed(rest, _DIGITS, key, b"phone" + code.encode()) if 5 <= len(digits) <= 15 and code[0] != "0" else None
    return new and _refill(x, code + new)


def _email(x: str, key: bytes) -> str:
    local, _, host = x.rpartition("@")
    name, _, top = host.rpartition(".")
    return f"{_mixed(local, _RADIX, key, b'mailbox')}@{_mixed(name, _RADIX, key, b'host')}.{top}"


def _secret(x: str, key: bytes) -> str:
    if re.fullmatch("[0-9a-f]+", x):
        return _mixed(x, _HEX, key, b"secret")
    if re.fullmatch("[0-9A-F]+", x):  # the same value, in capitals
        return _mixed(x.lower(), _HEX, key, b"secret").upper()
    head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-", x)[0]
    return head + _mixed(x[len(head) :], _RADIX, key, b"secret")


PSEUDONYMS: dict[str, Callable[[str, bytes], str | None]] = {
    "email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "ip6": _ip6, "ymd": _ymd, "dmy": _dmy, "number": _number,
    "ssn": _ssn, "phone": _phone,
}


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms for what is validated in it, and how many of each kind."""
    out, last, count, at = [], 0, {}, 0
    while m := _FORM.search(text, at):
        kind = m.lastgroup if m.lastgroup != "sep" else "dmy"
        new = PSEUDONYMS[kind](m[kind], key)
        if new is None:  # not valid: what starts later in it may be
            at = m.start() + 1
            continue
        out += [text[last : m.start()], new]
        count[kind] = count.get(kind, 0) + 1
        at = last = m.end()
    return ("".join(out) + text[last:] if out else text), count


def pseudonymised(docs: DataFrame, key: bytes) -> tuple[DataFrame, str]:
    """docs with pseudonyms in text, and one more column, whose name is returned: a map from kind to number found.

    Null and empty texts stay as they are. Rows are taken one by one, so
    repeated rows get the same pseudonyms; other columns are kept as they are.
    """
    (name,), columns = within(docs.columns, "pseudonyms"), docs.columns

    def run(batches):
        kind = pa.map_(pa.string(), pa.int64())
        for batch in batches:
            column = batch.column("text")
            data, at = utf8(column)
            new, counts = {}, [[]] * batch.num_rows
            raw = data.tobytes()
            for i in range(batch.num_rows):
                text = raw[at[i] : at[i + 1]]
                if _MAY.search(text):
                    changed, found = pseudonymise(text.decode(), key)
                    if found:
                        new[i], counts[i] = changed, sorted(found.items())
            if new:
                where = np.zeros(batch.num_rows, bool)
                where[list(new)] = True
                column = pc.replace_with_mask(column, pa.array(where), pa.array([new[i] for i in sorted(new)], column.type))
            yield pa.RecordBatch.from_arrays([*(column if c == "text" else batch.column(c) for c in columns), pa.array(counts, kind)], [*columns, name])

    schema = docs.withColumn(name, F.lit(None).cast("map<string,long>")).schema
    return docs.mapInArrow(run, schema), name


def session_key(spark: SparkSession) -> bytes:
    """The key of this session: the setting spark.terrane.pii.secret, or one made at random for it."""
    if not (key := spark.conf.get(KEY_SETTING, None)):
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key.encode()


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_found, and kinds (kind=number, comma-joined)."""
    out, found = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    kinds = F.transform(F.map_entries(found), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    total = F.aggregate(F.map_values(found), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "text", total.alias("n_found"), F.array_join(kinds, ",").alias("kinds"))

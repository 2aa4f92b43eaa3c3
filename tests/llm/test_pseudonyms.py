"""Each format is permuted in itself: one to one, valid stays valid, and only a key turns it back."""

import datetime
import hashlib
import ipaddress
import random
import re

from terrane.llm import pii

KEY = b"a key of these tests"


def days():
    first = datetime.date(1900, 1, 1)
    return [first + datetime.timedelta(k) for k in range(73049)]


def test_dates_in_every_order_and_width_are_one_to_one():
    texts = set()
    for d in days()[::7]:  # each string of a format once
        texts |= {d.isoformat(), f"{d.day:02d}/{d.month:02d}/{d.year}", f"{d.month:02d}/{d.day:02d}/{d.year}", f"{d.day}.{d.month}.{d.year}", f"{d.month}/{d.day:02d}/{d.year}"}
    new = {x: pii.pseudonymise(x, KEY)[0] for x in texts}
    assert len(set(new.values())) == len(texts)
    shape = lambda x: (len(x), re.sub(r"\d", "", x))
    assert all(shape(x)[1] == shape(y)[1] for x, y in new.items())
    assert all(list(map(len, re.split("[./-]", x)))[:1] == list(map(len, re.split("[./-]", y)))[:1] for x, y in new.items() if len(re.split("[./-]", x)[0]) < 3 and len(re.split("[./-]", x)[0]) == 1)
    assert pii.pseudonymise("22/11/1992 11/22/1992", KEY)[0].split()[0] != pii.pseudonymise("11/22/1992", KEY)[0]


def test_all_days_of_one_format_are_a_permutation():
    some = [f"{d.day:02d}/{d.month:02d}/{d.year}" for d in days()]
    assert {pii._dmy(x, KEY) for x in some} == set(some)
    month_first = [f"{d.month:02d}/{d.day:02d}/{d.year}" for d in days() if d.day > 12]
    assert {pii._dmy(x, KEY) for x in month_first} == set(month_first)
    short = [f"{d.day}.{d.month}.{d.year}" for d in days() if d.day < 10 and d.month < 10]
    assert {pii._dmy(x, KEY) for x in short} == set(short)


def test_valid_numbers_stay_valid_and_others_not():
    rng = random.Random(3)
    ssn = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"
    numbers = {f"{rng.choice((0, 666, 950, rng.randint(1, 899))):03d}-{rng.randint(0, 99):02d}-{rng.randint(0, 9999):04d}" for _ in range(3000)}
    new = {x: pii.pseudonymise(x, KEY)[0] for x in numbers}
    assert len(set(new.values())) == len(numbers) and all(ssn(x) == ssn(y) for x, y in new.items()) and {ssn(x) for x in numbers} == {True, False}
    phone = lambda x: re.sub(r"\D", "", x)[-10] > "1" and re.sub(r"\D", "", x)[-7] > "1"
    numbers = {f"+1 ({rng.randint(0, 999):03d}) 555-{rng.randint(0, 9999):04d}" for _ in range(3000)}
    new = {x: pii.pseudonymise(x, KEY)[0] for x in numbers}
    assert len(set(new.values())) == len(numbers) and all(phone(x) == phone(y) and y[:3] == "+1 " for x, y in new.items())
    for x, code in (("+49 30 1234567", "+49 "), ("+351 21 123 4567", "+351 "), ("+442071234567", "+44")):
        y = pii.pseudonymise("call " + x, KEY)[0].removeprefix("call ")
        assert y.startswith(code) and y != x and re.sub(r"\d", "0", x) == re.sub(r"\d", "0", y)


def test_keys_are_the_callers(spark):
    text = "mail jo@mail.example.com or 10.1.2.3"
    assert pii.pseudonymise(text, b"a")[0] != pii.pseudonymise(text, b"b")[0]
    before = spark.conf.get(pii.KEY_SETTING, None)
    try:
        spark.conf.unset(pii.KEY_SETTING)
        key = pii.session_key(spark)
        assert len(key) == 64 and pii.session_key(spark) == key
        spark.conf.set(pii.KEY_SETTING, "mine")
        assert pii.session_key(spark) == b"mine"
    finally:
        spark.conf.set(pii.KEY_SETTING, before) if before else spark.conf.unset(pii.KEY_SETTING)


def plain_permute(x, size, tweak):
    """Feistel rounds written on strings of bits, walked until the number is small enough."""
    width = len(f"{size - 1:b}") if size > 1 else 1
    half = max(1, (width + 1) // 2)
    tweak = hashlib.blake2b(tweak + size.to_bytes((size.bit_length() + 7) // 8, "big"), key=KEY, digest_size=16).digest()
    while True:
        bits = f"{x:0{2 * half}b}"
        left, right = bits[:half], bits[half:]
        for i in range(8):
            h = hashlib.blake2b(tweak + bytes([i]) + int(right, 2).to_bytes((half + 7) // 8, "big"), key=KEY, digest_size=64)
            f = f"{int.from_bytes(h.digest(), 'big'):0512b}"[-half:]
            left, right = right, "".join("01"[p != q] for p, q in zip(left, f))
        x = int(left + right, 2)
        if x < size:
            return x


def plain_digits(digits, tweak):
    return f"{plain_permute(int(digits), 10 ** len(digits), tweak):0{len(digits)}d}"


def check_digit(body):
    return next(c for c in "0123456789" if sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(body + c))) % 10 == 0)


def plain_value(kind, x):
    """The pseudonym of a valid value, by a formula of its own for each format."""
    if kind == "card":
        body = plain_digits(x[:-1], b"card")
        return body + check_digit(body)
    if kind == "ssn":
        digits = x.replace("-", "")
        while True:
            digits = plain_digits(digits, b"ssn")
            if digits[:3] not in ("000", "666") and digits[0] < "9" and int(digits[3:5]) and int(digits[5:]):
                return f"{digits[:3]}-{digits[3:5]}-{digits[5:]}"
    if kind == "iso":
        day = datetime.date.fromisoformat(x)
        recent = 1900 <= day.year <= 2099
        while True:
            n = plain_permute((day - datetime.date(1900, 1, 1)).days, 73049, b"date") if recent else plain_permute(day.toordinal() - 1, datetime.date(9999, 12, 31).toordinal(), b"far date")
            day = datetime.date(1900, 1, 1) + datetime.timedelta(n) if recent else datetime.date.fromordinal(n + 1)
            if recent == (1900 <= day.year <= 2099):
                return day.isoformat()
    if kind == "ip":
        a, b, c, d = map(int, x.split("."))
        n = plain_permute(((a * 256 + b) * 256 + c) * 256 + d, 2**32, b"ip")
        return ".".join(str(n // 256**k % 256) for k in (3, 2, 1, 0))
    if kind == "ip6":
        groups = [int(g, 16) for g in x.split(":")]
        return str(ipaddress.IPv6Address(plain_permute(sum(g << 16 * k for k, g in enumerate(reversed(groups))), 2**128, b"ip6")))
    if kind == "hex":
        return f"{plain_permute(int(x, 16), 16 ** len(x), b'secret'):0{len(x)}x}"
    if kind == "phone":
        digits = re.sub("[^0-9]", "", x)
        while True:
            digits = plain_digits(digits, b"phone1")
            if digits[0] in "23456789" and digits[3] in "23456789":
                return f"({digits[:3]}) {digits[3:6]}-{digits[6:]}"
    if kind == "national":
        digits = x.replace(" ", "")
        while True:
            digits = plain_digits(digits, b"national")
            if digits[0] == "0" and digits[1] != "0":
                return f"{digits[:3]} {digits[3:]}"
    if kind == "iban":
        country, rest = x[:2], x[4:]
        rest = plain_digits(rest, b"iban" + country.encode())
        number = rest + "".join(str("ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c) + 10) for c in country)
        return f"{country}{98 - int(number + '00') % 97:02d}{rest}"
    raise AssertionError(kind)


def test_values_of_a_table_match_a_plain_version(spark):
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def value(kind):
        if kind == "card":
            body = digits(15)
            return body + check_digit(body)
        if kind == "iban":
            rest = digits(18)
            return f"DE{98 - int(rest + '131400') % 97:02d}{rest}"
        return {
            "ssn": f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
            "iso": f"{rng.choice((1492, 1899, 1950, 2024, 2150))}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
            "ip": ".".join(str(rng.randint(0, 255)) for _ in range(4)),
            "ip6": ":".join(f"{rng.randint(1, 65535):x}" for _ in range(8)),
            "hex": "".join(rng.choice("0123456789abcdef") for _ in range(39)) + "7",
            "phone": f"({rng.randint(2, 9)}{digits(2)}) {rng.randint(2, 9)}{digits(2)}-{digits(4)}",
            "national": f"0{rng.randint(1, 9)}{digits(1)} {digits(7)}",
        }[kind]

    kinds = ["card", "iban", "ssn", "iso", "ip", "ip6", "hex", "phone", "national"]
    rows, want = [], {}
    for i in range(400):
        found = [(k, value(k)) for k in rng.sample(kinds, rng.randint(0, 4))]
        found = [(k, x) for k, x in found if k != "ip6" or re.search(r"\d", x)]
        pad = lambda: " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 9)))
        parts = [(pad(), k, x) for k, x in found]
        tail = pad()
        rows.append((i, "".join(f"{p} {x} " for p, _, x in parts) + tail))
        want[i] = "".join(f"{p} {plain_value(k, x)} " for p, k, x in parts) + tail
    out, name = pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), KEY)
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_what_is_not_valid_stays():
    for x in ("ISBN 9780306406150", "at 1700000000000 ms", "000-12-3456", "666-12-3456", "123-00-4567", "+1 (017) 555-0001", "(017) 555-0001", "2023-02-30", "45/13/2020", "300.1.2.3", "12:34:56", "std::vector", "a::b::c", "+999 1", "0123", "10 000 000", "00 49 30"):
        assert pii.pseudonymise(x, KEY) == (x, {}), x
    for x, kind in (("2001:db8::8a2e:370:7334", "ip6"), ("FE80::1:2:3", "ip6"), ("1066-10-14", "ymd"), ("030 1234567", "phone"), ("+49 30 1234567", "phone")):
        new, count = pii.pseudonymise(x, KEY)
        assert new != x and count == {kind: 1}, x


def test_far_dates_are_one_to_one():
    some = {datetime.date.fromordinal(n).isoformat() for n in (*range(1, 690000, 97), *range(770000, 3652059, 997))}
    new = {pii._ymd(x, KEY) for x in some}
    assert len(new) == len(some) and all(not "1900" <= x[:4] <= "2099" for x in new)
    assert pii._ymd("1955-01-01", KEY)[:2] in ("19", "20")


def test_the_key_is_blanked_out_in_logs(spark):
    form = spark.sparkContext.getConf().get("spark.redaction.regex", None) or "(?i)secret|password|token|access[.]?key"
    assert re.search(form, pii.KEY_SETTING)

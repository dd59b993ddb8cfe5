"""The corpus operators against brute force and on awkward tables."""

from __future__ import annotations

import base64
import hashlib
import pickle
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from codexloom.llm import bpe, common, decontaminate, exact_dedup, line_dedup, paragraphs, pii, quality, registry, simhash, suffix_dedup, warc
from tests.compare import SF, by_sql, rows

SCHEMA = "doc_id long, text string, lang string, _salt int, kept string"
#: Null ids and texts, empty and blank texts, ties, repeated rows, accents, a very long text, and columns whose names the operators use inside.
AWKWARD = [(None, "x y z", "en", 1, "k"), (1, None, None, None, None), (2, "", "en", 1, ""), (3, " \n\t", "en", 2, "k"), (4, "Same TEXT é here", "en", 3, "k"), (5, "same text é here", "en", 3, "k"),
           (5, "same text é here", "en", 3, "k"), (6, "same text É here", "en", 3, "k"), (7, "long words " * 30_000, "en", 4, "k"), (8, "\n".join(["A line of more than forty characters, again."] * 3), "en", 5, "k")]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == by_sql(registry.ORACLES[name])


def test_components(spark):
    def roots(pairs):
        return {r["node"]: r["root"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}

    chain = [(i, i + 1) for i in range(60)]
    assert roots(chain) == {i: 0 for i in range(61)}
    assert roots([(5, 5), (None, 1), (3, 2), (2, 9), (7, 8)]) == {2: 2, 3: 2, 9: 2, 7: 7, 8: 7}
    assert roots([]) == {}


# pseudonyms

def _feistel(key, kind, left, right, sides):
    for i in range(pii.ROUNDS):
        other = left if i % 2 else right
        step = int(hashlib.sha512(f"{key}|{kind}|{i}|{other}".encode()).hexdigest()[:12], 16)
        left, right = (left, (right + step) % sides[1]) if i % 2 else ((left + step) % sides[0], right)
    return left, right


def _feistel_text(key, kind, text, hexadecimal=False):
    half = len(text) // 2
    left, right = text[:half], text[half:]

    def shift(part, other, i):
        by = hashlib.sha512(f"{key}|{kind}|{i}|{other}".encode()).digest()
        out = ""
        for c, b in zip(part, by):
            own = next((a for a in ((pii.HEX,) if hexadecimal else (pii.DIGITS, pii.LOWER, pii.LOWER.upper())) if c in a), None)
            out += own[(own.index(c) + b) % len(own)] if own else c
        return out

    for i in range(pii.ROUNDS):
        left, right = (left, shift(right, left, i)) if i % 2 else (shift(left, right, i), right)
    return left + right


def _fill(shape, new):
    rest = iter(new)
    return "".join(next(rest) if re.match("[0-9A-Za-z]", c) else c for c in shape)


def _mod97(flat):
    return int("".join(str(int(c, 36)) for c in flat)) % 97


def _new_card(shape, key):
    body = _feistel_text(key, "card", re.sub("[^0-9]", "", shape)[:-1])
    return _fill(shape, next(body + str(d) for d in range(10) if luhn(body + str(d)) == 0))


def _new_iban(shape, key):
    flat = shape.replace(" ", "")
    body = _feistel_text(key, "iban", flat[4:])
    return _fill(shape, flat[:2] + f"{98 - _mod97(body + flat[:2] + '00'):02d}" + body)


# The finder, written apart from the operator's: what may be a value, and at which places. Most have one spelling only.
EDGE_L, EDGE_R = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
MAIL = r"[a-zA-Z\d][\w.%+-]{0,63}@(?:[a-zA-Z\d-]{1,63}\.){1,9}[a-zA-Z]{2,24}"
KEY_ID = r"AKIA[A-Z\d]{16}"
BANK = r"[A-Z][A-Z]\d\d(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?"
OCTETS = r"\d{1,3}(?:\.\d{1,3}){3}"
COLONS = r"[a-fA-F\d]{1,4}(?::[a-fA-F\d]{1,4}){7}"
SOCIAL = r"\d\d\d-\d\d-\d\d\d\d"
DAY_FIRST, YEAR_FIRST = r"\d\d?(?P<a>[-/.])\d\d?(?P=a)\d{4}", r"\d{4}(?P<b>[-/.])\d\d?(?P=b)\d\d?"
ANY_DATE = r"\d{4}[-/.]\d\d?[-/.]\d\d?|\d\d?[-/.]\d\d?[-/.]\d{4}"
FOREIGN = r"\+(?!1)\d{1,4}(?:[ .-]?(?:\(\d{1,4}\)|\d{2,4})){2,6}"
AMERICAN = r"(?:(?:\+1|1)[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
PLASTIC = r"(?=2[2-7]|3\d|4|5[1-5]|6[0245])(?<!\d{4}[ -]\d{4}[ -]\d{4}[ -])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?:[ -]\d{3})?|3[47]\d\d[ -]\d{6}[ -]\d{5}|3[0689]\d\d[ -]\d{6}[ -]\d{4})(?![ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\d))"
ASSIGNED = r"(?<=\b(?i:password|passwd|token|secret|api_key|apikey)\x20{0,2}[=:]\x20{0,2}[\"']?)[\w+/-]{8,}"
FINDER = regex.compile(f"{ASSIGNED}{EDGE_R}|{EDGE_L}(?=[0-9A-Za-z+(])(?:" + "|".join((MAIL, KEY_ID, BANK, OCTETS, COLONS, SOCIAL, ANY_DATE, FOREIGN, AMERICAN, PLASTIC)) + f"){EDGE_R}", regex.A)
TWO_DIGIT_CODES = [20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98]


def _country(digits):
    return "7" if digits[0] == "7" else digits[:2] if int(digits[:2]) in TWO_DIGIT_CODES else digits[:3]


def _issued(d):
    """Whether a number has an issuer's first digits and length."""
    n, four = len(d), int(d[:4])
    return (d[0] == "4" and n in (13, 16, 19) or n == 16 and (5100 <= four <= 5599 or 2221 <= four <= 2720) or n == 15 and d[:2] in ("34", "37")
            or n == 14 and (3000 <= four <= 3059 or d[:2] in ("36", "38", "39")) or 16 <= n <= 19 and (four == 6011 or 6440 <= four <= 6599 or 3528 <= four <= 3589 or d[:2] == "62"))


def _by_groups(found, valid, change):
    parts, out, i = re.findall("[0-9A-Z]+|[ -]", found), "", 0
    while i < len(parts):
        end = next((j for j in range(len(parts), i, -1) if i % 2 == 0 and j % 2 and valid(re.sub("[ -]", "", "".join(parts[i:j])))), None)
        out += change("".join(parts[i:end])) if end else parts[i]
        i = end or i + 1
    return out


def _new_date(found, key):
    import datetime

    p, sep = re.split("[-/.]", found), re.search("[-/.]", found)[0]
    lead = len(p[0]) == 4
    us = not lead and sep == "/" and int(p[0]) <= 12
    y, m, d = p if lead else (p[2], p[0], p[1]) if us else (p[2], p[1], p[0])
    start = datetime.date.fromisoformat(pii.FIRST_DAY)
    try:
        at = (datetime.date(int(y), int(m), int(d)) - start).days
    except ValueError:
        return found
    if not 0 <= at < pii.DAYS:
        return found
    while True:
        a, b = _feistel(key, "date", at // pii.DAY_SIDES[1], at % pii.DAY_SIDES[1], pii.DAY_SIDES)
        if (at := a * pii.DAY_SIDES[1] + b) < pii.DAYS:
            break
    new = start + datetime.timedelta(at)
    m, d = (f"{x:0{2 if len(like) == 2 else 1}d}" for x, like in ((new.month, m), (new.day, d)))
    return sep.join((str(new.year), m, d) if lead else (m, d, str(new.year)) if us else (d, m, str(new.year)))


def _pseudonym(found, key=pii.DEMO_KEY):
    """The pseudonym of a candidate by plain Python."""
    whole = lambda p: re.fullmatch(p, found, re.A)
    digits = re.sub("[^0-9]", "", found)
    if whole(MAIL):
        name, at, host = found.lower().partition("@")
        return _feistel_text(key, "email", name) + at + host
    if whole(KEY_ID):
        return "AKIA" + _feistel_text(key, "access", found[4:])
    if whole(OCTETS):
        o = [int(x) for x in found.split(".")]
        if max(o) > 255:
            return found
        a, b = _feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536))
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    if whole(COLONS):
        groups = found.split(":")
        flat = _feistel_text(key, "ipv6", "".join(g.lower().zfill(4) for g in groups), True)
        new = [flat[i:i + 4] for i in range(0, 32, 4)]
        return ":".join(new if all(len(g) == 4 for g in groups) else [g.lstrip("0") or "0" for g in new])
    if whole(SOCIAL):
        area, group, serial = (int(x) for x in found.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return found
        a, b = _feistel(key, "ssn", (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, (898 * 99, 9999))
        return f"{a // 99 + 1 + (a // 99 >= 665):03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    if whole(YEAR_FIRST) or whole(DAY_FIRST):
        return _new_date(found, key)
    if whole(FOREIGN):
        country = _country(digits)
        return _fill(found, country + _feistel_text(key, "abroad", digits[len(country):])) if 8 <= len(digits) <= 15 else found
    if whole(AMERICAN):
        area, rest = int(digits[-10:-7]), int(digits[-7:])
        if area < 200 or rest < 2_000_000:
            return found
        a, b = _feistel(key, "phone", area - 200, rest - 2_000_000, (800, 8_000_000))
        return _fill(found, digits[:-10] + f"{a + 200}{b + 2_000_000:07d}")
    if regex.fullmatch(PLASTIC, found, regex.A):
        return _new_card(found, key) if _issued(digits) and luhn(digits) == 0 else found
    if whole(BANK):
        return _by_groups(found, lambda d: bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{8,31}", d)) and _mod97(d[4:] + d[:4]) == 1, lambda x: _new_iban(x, key))
    if whole(ANY_DATE):
        return found
    pieces = [found[i:i + 64] for i in range(0, len(found), 64)]
    return "".join(_feistel_text(key, "secret", x, bool(re.fullmatch("[0-9a-f]+", x))) for x in pieces)


def _pseudonymised(text):
    """(text, how many values changed) by plain Python."""
    found = []

    def new(m):
        found.append((m.group(), _pseudonym(m.group())))
        return found[-1][1]

    out = FINDER.sub(new, text) if text is not None else None
    return out, sum(a != b for a, b in found)


def test_pseudonyms_of_all_documents(spark, documents):
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in registry.QUERIES["op1_pii"](spark, SF).collect()}
    want = {d: _pseudonymised(t) for d, t in documents.items()}
    assert got == want and sum(n for _, n in want.values()) > 10
    # what has no candidate stays as it is
    assert all(got[d][0] == t for d, t in documents.items() if not FINDER.search(t))


def test_pseudonyms_of_every_kind(spark):
    rng = np.random.default_rng(12)
    num = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    values = []
    for _ in range(40):
        card = num(15)
        values += [next(card + str(d) for d in range(10) if luhn(card + str(d)) == 0), num(16), f"{num(3)}-{num(2)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+1 {num(3)}.{num(3)}.{num(4)}",
                   f"+44 {num(2)} {num(4)} {num(4)}", f"+353{num(8)}", f"+7 ({num(3)}) {num(3)}-{num(2)}-{num(2)}", f"{num(4)}-{num(2)}-{num(2)}", f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/19{num(2)}",
                   f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.20{num(2)}", ".".join(str(x) for x in rng.integers(0, 300, 4)), ":".join(f"{x:x}" for x in rng.integers(0, 65536, 8)),
                   ":".join(f"{x:04x}" for x in rng.integers(0, 65536, 8)), f"user.{num(2)}@mail.example.com", f"AKIA{num(16)}", f"password = '{num(9)}aB_x'", f"api_key: {num(80)}"]
    texts = [(i, f"of {v}, and {w}") for i, (v, w) in enumerate(zip(values, values[1:]))]
    got = pii.pseudonymise(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["n_replaced"]) for r in got} == {i: _pseudonymised(t) for i, t in texts}
    # two spellings of a number stay linked, impossible numbers stay
    a, b, c = (pii.pseudonymise(spark.createDataFrame([(1, x)], "i int, text string")).first()["text"] for x in ("+44 20 7946 0958", "+442079460958", "(125) 555-7196"))
    assert a.replace(" ", "") == b != "+442079460958" and b.startswith("+44") and c == "(125) 555-7196"


def test_tables_of_numbers(spark):
    """A long text of plain numbers is left alone, and takes time in proportion to its length."""
    rng = np.random.default_rng(4)
    table = " ".join(f"{x:04d}" for x in rng.integers(0, 10_000, 20_000))
    cards = ["4111 1111 1111 1111", "2024 4111-1111-1111-1111 12/25", "3782 822463 10005", "6011111111111117 55", "(269) 555-3296 4111 1111 1111 1111", "3056 930902 5904"]
    others = ["9656005089711094", "4111 1111 1111 1112", "4111 11 1111 1111 11", "1234 5678 9012 3452", "3782 822463 10004"]
    rows = [(0, table), *enumerate(cards, 1), *enumerate(others, 11)]
    spark.createDataFrame(rows[:1], "doc_id int, text string").count()
    began = time.time()
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert time.time() - began < 60
    assert got[0] == (table, 0) and all(got[i] == (t, 0) for i, t in enumerate(others, 11))
    assert [got[i][1] for i in range(1, 7)] == [1, 1, 1, 1, 2, 1]
    assert {i: got[i] for i, _ in rows} == {i: _pseudonymised(t) for i, t in rows}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10


def test_pseudonyms_against_python(spark):
    ip = "55.253.138.97"
    o = [int(x) for x in ip.split(".")]
    a, b = _feistel(pii.DEMO_KEY, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536))
    body = _feistel_text(pii.DEMO_KEY, "card", "411111111111111")
    card = next(body + str(d) for d in range(10) if luhn(body + str(d)) == 0)
    mail = _feistel_text(pii.DEMO_KEY, "email", "ann.b-7") + "@mail.example.com"
    l, r = _feistel(pii.DEMO_KEY, "phone", 425, 355 * 10_000 + 7196, (800, 8_000_000))
    phone = f"{l + 200}{r + 2_000_000:07d}"
    text = f"ip {ip} card 4111-1111 1111 1111, Ann.B-7@mail.example.com +1 (625) 555-7196; 4111111111111112 300.1.1.1 2001-02-29"
    want = f"ip {a >> 8}.{a & 255}.{b >> 8}.{b & 255} card {card[:4]}-{card[4:8]} {card[8:12]} {card[12:]}, {mail} +1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}; 4111111111111112 300.1.1.1 2001-02-29"
    r = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r["text"] == want and r["n_replaced"] == 4


def test_pseudonyms_are_permutations(spark):
    days = spark.range(pii.DAYS).select(pii.permute_day(F.col("id"), "k").alias("v")).agg(F.countDistinct("v"), F.min("v"), F.max("v")).first()
    assert tuple(days) == (pii.DAYS, 0, pii.DAYS - 1)
    n = spark.range(10_000).select(pii.permute_text(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "t").alias("v"))
    assert n.distinct().count() == 10_000 and n.where("not v rlike '^[0-9]{4}$'").count() == 0
    ssn = spark.range(300).select(F.format_string("%03d-%02d-%04d", F.col("id") % 899 + 1, F.col("id") % 99 + 1, F.col("id") + 1).alias("s"))
    got = ssn.select("s", pii.pseudonym(F.col("s")).alias("v")).where("s not like '666%'")
    assert got.select("v").distinct().count() == got.count() and got.where(~F.col("v").rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")).count() == 0


def test_dates_and_ibans_stay_valid_and_linked(spark):
    t = ["born 1980-03-04", "03/04/1980 it was", "4.3.1980", "31/12/1999 and 2099-12-31", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, text string")).orderBy("i").collect()]
    y, m, d = re.search(r"(\d{4})-(\d\d)-(\d\d)", got[0]).groups()
    assert got[1].startswith(f"{m}/{d}/{y}") and got[2] == f"{int(d)}.{int(m)}.{y}" and got[4].replace(" ", "") == got[5] != t[5]
    flat = got[5][4:] + got[5][:4]
    assert int("".join(str(int(c, 36)) for c in flat)) % 97 == 1


def test_neighbours_of_valid_numbers(spark):
    secret = "aB3" * 50
    t = ["4111111111111111 123", "4111 1111 1111 1111 12/27", "12 4111 1111 1111 1111", "4111 1111 1111 1111 555-123-4567", "2023-01-01 2023-12-31",
         "ES91 2100 0418 4502 0005 1332 EUR", f"token={secret}", "4111 1111 1111 1111 2nd", "4111 1111 1111 1111 4111 1111 1111 1111"]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, text string")).orderBy("i").collect()]
    alone = lambda x: pii.pseudonymise(spark.createDataFrame([(1, x)], "i int, text string")).first()["text"]
    card = alone("4111 1111 1111 1111")
    assert card != "4111 1111 1111 1111" and got[0] == card.replace(" ", "") + " 123" and got[1] == card + " 12/27" and got[2] == "12 " + card
    assert got[3] == card + " " + alone("555-123-4567") and got[4] == alone("2023-01-01") + " " + alone("2023-12-31")
    iban = got[5].removesuffix(" EUR").replace(" ", "")
    assert iban != t[5][:-4].replace(" ", "") and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert len(got[6]) == len(t[6]) and not any(got[6][6 + i:][:12] == secret[i:][:12] for i in range(0, 139))
    assert got[7] == card + " 2nd" and got[8] == card + " " + card


# archives

def test_archives_salvage():
    def rec(i, body, kind="response", digest=None):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        digest = digest or hashlib.sha1(body).hexdigest()
        return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    good = [rec(i, b"body %d WARC/1.1\r\n" % i) for i in range(5)]
    ids = lambda data: [x[4]["warc-record-id"] for x in warc.salvage(data) if x[0] == "record"]
    gaps = lambda data: sum(x[3] for x in warc.salvage(data) if x[0] == "gap")
    whole = b"".join(good)
    assert ids(whole) == [f"<urn:{i}>" for i in range(5)] and gaps(whole) == 0
    torn = good[0] + good[1][:-20] + good[2] + b"noise" + good[3] + rec(9, b"x", digest="0" * 40) + good[4]
    assert ids(torn) == ["<urn:0>", "<urn:2>", "<urn:3>", "<urn:4>"] and gaps(torn) == len(torn) - sum(len(good[i]) for i in (0, 2, 3, 4))
    assert ids(whole.replace(b"Content-Length: ", b"Content-Length: 9", 1)) == [f"<urn:{i}>" for i in range(1, 5)]

    def gz(data):
        c = zlib.compressobj(wbits=31)
        return c.compress(data) + c.flush()

    members = [gz(x) for x in good]
    broken = members[0] + members[1][:30] + members[2] + b"\x00" * 7 + members[3] + gz(good[4] + good[0])
    assert ids(broken) == ["<urn:0>", "<urn:2>", "<urn:3>", "<urn:4>", "<urn:0>"] and gaps(broken) == 37
    assert list(warc.salvage(b"")) == [] and gaps(b"junk") == 4


def test_damaged_member_of_many_records():
    def rec(i):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + hashlib.sha512(b"%d" % i).hexdigest().encode() * 3
        return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Type: application/http\r\n"
                f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    c = zlib.compressobj(wbits=31)
    member = c.compress(b"".join(map(rec, range(400)))) + c.flush()
    found = lambda data: [x[4]["warc-record-id"] for x in warc.salvage(data) if x[0] == "record"]
    # one byte of the check sum
    assert found(member[:-6] + bytes([member[-6] ^ 1]) + member[-5:]) == [f"<urn:{i}>" for i in range(400)]
    # a block of a type that does not exist, after the first half
    c = zlib.compressobj(wbits=31)
    half = c.compress(b"".join(map(rec, range(200)))) + c.flush(zlib.Z_FULL_FLUSH)
    assert found(half + b"\xff" * 50) == [f"<urn:{i}>" for i in range(200)]


def test_one_damaged_byte_of_an_archive(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>page {i} " + "text " * i) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path = f"{common.shared_dir(spark)}/warc"
    warc.write_warc(pages, path, per_file=25)
    files = sorted((len(bytes(r["content"])), r["path"], bytes(r["content"])) for r in spark.read.format("binaryFile").load(path).collect())
    assert len(files) == 2
    data = files[-1][2]
    whole = list(warc.salvage(data))
    assert [x[0] for x in whole] == ["record"] * 25 and data.count(b"\x1f\x8b\x08") == 25
    starts = [m.start() for m in re.finditer(b"\x1f\x8b\x08", data)] + [len(data)]
    rng = np.random.default_rng(3)
    for at in [int(x) for x in rng.integers(0, len(data), 60)] + [0, 3, len(data) - 1]:
        bad = bytearray(data)
        bad[at] ^= 1 + at % 255
        got = list(warc.salvage(bytes(bad)))
        gaps, member = [x for x in got if x[0] == "gap"], max(i for i, x in enumerate(starts) if x <= at)
        ids = {x[4]["warc-record-id"] for x in got if x[0] == "record"}
        lost = [i for i, x in enumerate(whole) if x[4]["warc-record-id"] not in ids]
        # only the damaged member can be lost; damage to its frame alone leaves its record whole
        assert lost in ([], [member])
        if lost:
            assert sum(x[3] for x in gaps) == starts[member + 1] - starts[member] or (len(gaps) == 1 and gaps[0][1] == starts[member])
        else:
            assert len(gaps) <= 1


def test_search_for_records_is_linear():
    import time

    data = b"\x1f\x8b\x08junk" * 30_000
    began = time.time()
    assert [x[0] for x in warc.salvage(data)] == ["gap"] and time.time() - began < 20


def test_archives_of_awkward_pages(spark):
    big = "é" * 600
    pages = [(1, "u", big), (2, "u\r\nx", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", big), (None, "u", big)]
    path = f"{common.shared_dir(spark)}/warc"
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), path, per_file=2)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    got = {r["record_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], bytes(r["payload"]).decode()) for r in warc.read_warc(files).where("kind = 'record'").collect()}
    first = f"{warc.URN}7"
    assert got[first] == ("response", None, 1200, big)
    assert {got[f"{warc.URN}{i}"] for i in (1, 2, "")} == {("revisit", first, 1200, "")}
    assert got[f"{warc.URN}3"] == ("response", None, 0, "") and got[f"{warc.URN}6"] == ("response", None, 5, "short")
    small = f"{common.shared_dir(spark)}/warc"
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), small, file_bytes=1)
    assert spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(small).count() == len(pages)
    empty = f"{common.shared_dir(spark)}/warc"
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)


def test_query_over_null_and_repeated_page_ids(spark, tmp_path):
    """The registered query itself on awkward ids."""
    big = "é" * 600
    pages = [(None, "u", big), (3, "u", big), (3, "u", big), (4, "u", None), (None, "u", "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.op2_warc(spark, str(tmp_path)).collect()), key=str)
    assert [r for r in got if r[0] is None] == [(None, 1, "response", None), (None, 1200, "revisit", 3)]
    assert [r for r in got if r[0] == 4] == [(4, 0, "response", None)]
    assert [r[:2] for r in got if r[0] == 3] == [(3, 1200)] * 2


# paragraphs

def _paragraph_classes(texts):
    occ, first = [], {}
    for d, t in texts:
        for pos, line in enumerate((t or "").split("\n")):
            if (p := paragraphs.normal(line.encode())) is not None:
                occ.append((d, pos, p))
                first.setdefault(p, (d, pos))
    keys = list(first)
    sets = [paragraphs.shingles(k) for k in keys]
    inv = {}
    for i, x in enumerate(sets):
        for g in x:
            inv.setdefault(g, []).append(i)
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, n in Counter(j for g in x for j in inv[g] if j > i).items():
            if n >= 0.8 * (len(x) + len(sets[j]) - n):
                root[find(j)] = find(i)
    keep = {}
    for i, k in enumerate(keys):
        keep[find(i)] = min(keep.get(find(i), (1 << 62, 0)), first[k])
    index = {k: i for i, k in enumerate(keys)}
    places = Counter(find(index[p]) for _, _, p in occ)
    return {(d, pos): places[find(index[p])] for d, pos, p in occ if keep[find(index[p])] != (d, pos)}


def _in_long_runs(text, copies):
    """Positions of copies (with their places) in runs of 20 words, by cutting the text at the lines that are neither copies nor blank, and of those that stand in fewer than five places."""
    lines = (text or "").split("\n")
    marks = "".join("c" if i in copies else " " if not x.split() else "x" for i, x in enumerate(lines))
    out = set()
    for m in re.finditer("[c ]+", marks):
        own = [i for i in range(*m.span()) if marks[i] == "c"]
        if sum(len(lines[i].split()) for i in own) >= 20:
            out.update(own)
    return out | {i for i, n in copies.items() if n < 5}


@pytest.mark.parametrize("bucket", [256, 3])
def test_paragraphs_against_brute_force(spark, documents, bucket, monkeypatch):
    own = paragraphs.similar_classes
    monkeypatch.setattr(paragraphs, "similar_classes", lambda *a: own(*a, bucket=bucket))
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in registry.QUERIES["op3_paragraphs"](spark, SF).collect()}
    copies, want = _paragraph_classes(sorted(documents.items())), {}
    for d, t in documents.items():
        gone = _in_long_runs(t, {pos: n for (e, pos), n in copies.items() if e == d})
        want[d] = (len(gone), "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    assert got == want and any(n for n, _ in got.values())


def test_many_near_copies_of_one_paragraph(spark):
    rng = np.random.default_rng(5)
    base = [f"word{i}" for i in range(80)]
    docs = []
    for d in range(120):
        own = list(base)
        own[rng.integers(80)] = f"other{d}"
        docs.append((d, " ".join(own)))
    lost = paragraphs.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string").withColumn("_row", F.col("doc_id")))
    assert lost.count() == 119


@pytest.mark.parametrize("bucket", [3, 1])
def test_chains_through_a_large_bucket(spark, bucket):
    words, docs = [f"word{i}" for i in range(200)], []
    for d in range(4):
        docs.append((d, " ".join(words)))
        for at in range(10 + 20 * d, 190, 70):
            words[at] = f"other{d}"
    sets = [paragraphs.shingles(t.encode()) for _, t in docs]
    assert [paragraphs.similar(sets[i], sets[j]) for i, j in ((0, 1), (1, 2), (2, 3), (0, 2), (1, 3))] == [True] * 3 + [False] * 2
    table = spark.createDataFrame(docs, "_row long, text string")
    # all share one bucket, which the end of the chain leads
    classes = table.select((3 - F.col("_row")).alias("pid"), "_row", F.lit(0).alias("pos"), F.array(F.lit(1).cast("long")).alias("bands"))
    assert {(r["node"], r["root"]) for r in paragraphs.similar_classes(table, classes, bucket=bucket).collect()} == {(i, 0) for i in range(4)}


def _lines_classes(spark, lines, bucket, monkeypatch):
    """(roots by the operator, roots by all pairs) of different lines, one per document."""
    own = paragraphs.similar_classes
    monkeypatch.setattr(paragraphs, "similar_classes", lambda *a: own(*a, bucket=bucket))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").withColumn("_row", F.col("doc_id"))
    lost = {r["_row"] for r in paragraphs.repeated_paragraphs(docs).collect()}
    return lost, {d for d, _ in _paragraph_classes(list(enumerate(lines)))}


@pytest.mark.parametrize("bucket", [16, 6])
def test_variants_of_variants_stay_one_component(spark, bucket, monkeypatch):
    rng = np.random.default_rng(1)
    base = [f"word{i}" for i in range(100)]
    one = []
    for d in range(60):
        own = list(base)
        for at in rng.choice(100, 2, replace=False):
            own[at] = f"a{d}x{at}"
        one.append(own)
    two = []
    for d, words in enumerate(one):
        own = list(words)
        own[rng.integers(100)] = f"b{d}"
        two.append(own)
    lines = [" ".join(x) for x in [base, *one, *two]]
    got, want = _lines_classes(spark, lines, bucket, monkeypatch)
    assert got == want and len(want) > 100


def test_lines_just_below_the_similarity_end(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base, lines = [f"word{i}" for i in range(60)], []
    for d in range(120):
        own = list(base)
        own[rng.integers(60)] = f"own{d}"
        lines.append(" ".join(own))
    sets = [paragraphs.shingles(x.encode()) for x in lines]
    near = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert 0.7 < np.mean(near) < 0.85
    got, want = _lines_classes(spark, lines, 6, monkeypatch)
    assert got == want


def test_paragraphs_of_few_words(spark):
    words = [f"word{i}" for i in range(19)]
    docs = [(d, "\n".join([" ".join(words[:n]) for n in (5, 8, 12, 18)] + [f"own{d} " * 4])) for d in range(2)]
    docs.append((2, " ".join(words[:17]) + " other17"))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in paragraphs.drop_near_paragraphs(table).collect()}
    # four copies of 43 words in a row are a passage; one of 18 words stands in three places only
    assert [got[d][0] for d in range(3)] == [0, 4, 1] and got[0][1] == docs[0][1] and got[1][1] == "own1 " * 4 and got[2][1] == ""
    got = {r["doc_id"]: r["n_removed"] for r in paragraphs.drop_near_paragraphs(table, min_run=5).collect()}
    assert got == {0: 0, 1: 4, 2: 1}


def test_short_paragraphs_in_few_places(spark):
    """Fifteen words in three documents and nineteen in two go, a phrase in six documents stays."""
    word = lambda n, k: " ".join(f"{k}word{i}" for i in range(n))
    docs = [(d, "\n".join([f"own{d} text", word(15, "a") if d < 3 else "x", word(19, "b") if d in (1, 4) else "y", word(6, "c"), f"end {d}"])) for d in range(6)]
    got = {r["doc_id"]: (r["n_removed"], r["text"].split("\n")) for r in paragraphs.drop_near_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: n for d, (n, _) in got.items()} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 2, 5: 0}
    # in document 4 the phrase is next to a copy of 19 words: together they are a passage
    assert all((word(6, "c") in got[d][1]) == (d != 4) for d in range(6))


def test_runs_of_copies():
    lines = [b"a b c d e f g", b"", b"a b c d e f g", b"short", b"a b c d e f g h i j k", b"  ", b"a b c d e f g h i"]
    assert paragraphs.long_runs(lines, {0, 2}) == set() and paragraphs.long_runs(lines, {0, 2}, 14) == {0, 2}
    assert paragraphs.long_runs(lines, {0, 2, 4, 6}) == {4, 6} and paragraphs.long_runs(lines, {0, 2}, rare={2}) == {2} and paragraphs.long_runs(lines, set()) == set() and paragraphs.long_runs([], set()) == set()


# fingerprints

def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_against_brute_force(spark, documents):
    ids = sorted(documents)
    fps = np.array([_fingerprint(documents[d]) for d in ids], np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 2):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.QUERIES["op4_simhash"](spark, SF).collect()}
    assert got == {d: (f"{int(fps[i]):016x}", ids[find(i)]) for i, d in enumerate(ids)}


def test_ball_links_find_every_pair(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)]
    fps = {b ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) for b in base for _ in range(4)} | {b ^ -(1 << 63) for b in base} | {0, 3, -1}
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    found = {r["node"]: r["root"] for r in common.components(links).collect()}
    for a in fps:
        for b in fps:
            if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
                assert found[a] == found[b]


# suffixes

def _without_repeats(docs, length=100):
    """{doc: (bytes, removed, spans, kept)} of (doc, text) rows in order."""
    seen, out = set(), {}
    for d, t in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i:i + length] in seen:
                gone[i:i + length] = True
            seen.add(b[i:i + length])
        out[d] = (len(b), int(gone.sum()), int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("wide, group", [(1024, 32 << 20), (2, 1000)])
def test_suffix_dedup_against_brute_force(spark, documents, wide, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "_GROUP", group)
    want = {d: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for d, x in _without_repeats(sorted(documents.items())).items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in registry.QUERIES["op5_suffix_dedup"](spark, SF).collect()}
    assert got == want


def _repeats_removed(spark, docs, length=100):
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length)
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()}


@pytest.mark.parametrize("parts", [[b"a" * 300], [b"abc" * 50, b"xabc" * 50, b"bca" * 40], [bytes(range(256)), bytes(range(100, 256))], [b"x" * 99, b"x" * 99]])
def test_merged_shards_give_all_repeats(parts):
    shards = [suffix_dedup.ShardBWT(parts[i:i + 1]) for i in range(len(parts))]
    shard, pos, block = suffix_dedup.merge_shards(shards)
    got = {}
    for s, p, b in zip(shard.tolist(), pos.tolist(), block.tolist()):
        got.setdefault(b, set()).add((s, p))
    strings = {}
    for s, t in enumerate(parts):
        for p in range(len(t) - 99):
            strings.setdefault(t[p:p + 100], set()).add((s, p))
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in strings.values() if len(x) > 1)


def test_suffix_dedup_of_periodic_and_tied_texts(spark):
    docs = [(1, "ab" * 400), (1, "ab" * 400), (2, "x" * 99), (2, "x" * 99), (None, "ab" * 60), (3, None), (4, "q" + "ab" * 50)]
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted([(-1, 120, 118), (1, 800, 800), (1, 800, 800), (2, 99, 0), (2, 99, 0), (3, 0, 0), (4, 101, 100)])


def test_suffix_dedup_of_other_lengths(spark, documents):
    docs = [(d, t) for d, t in sorted(documents.items()) if len(t) < 3000]
    for length in (16, 30, 400):
        assert _repeats_removed(spark, docs, length) == _without_repeats(docs, length)
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 8)


def test_suffix_dedup_of_a_passage_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDE", 50)
    rng = np.random.default_rng(9)
    word = lambda n: " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 7)) for _ in range(n))
    passage = word(40)
    docs = [(d, word(6) + passage + word(6)) for d in range(300)]
    got = _repeats_removed(spark, docs)
    assert got == _without_repeats(docs) and got[0][1] == 0 and all(got[d][1] >= len(passage) for d in range(1, 300))


# quality

def test_quality_on_held_out_documents(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    got = registry.QUERIES["op6_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.95 and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_machine_scores_by_the_definition():
    rng = np.random.default_rng(0)
    n = quality.N_DENSE + quality.BUCKETS
    m = quality.Machine(np.zeros(quality.N_DENSE), np.ones(quality.N_DENSE), 0.1, rng.normal(0, 0.1, n), rng.normal(0, 0.1, (n, 4)))
    texts = [b"", b"one Two two three!", "é è".encode() * 5]
    for text, score in zip(texts, m.score(texts)):
        doc, bucket, counts, dense = quality.word_features([text])
        x = np.zeros(n)
        x[:quality.N_DENSE] = np.clip(dense[0], -4, 4)
        x[quality.N_DENSE + bucket] = counts / np.sqrt(max(counts.sum(), 1))
        pairs = sum(x[i] * x[j] * (m.v[i] @ m.v[j]) for i in np.flatnonzero(x) for j in np.flatnonzero(x) if i < j)
        assert score == pytest.approx(1 / (1 + np.exp(-(0.1 + x @ m.w + pairs))))


def test_quality_without_labels(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(awkward, quality.train(awkward, none)).collect()} == {0.5}
    same = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert all(r["score"] > 0.9 for r in quality.score_documents(awkward, quality.train(awkward, same)).collect())


# exact and line dedup

def test_index_survives_its_session(spark):
    """A session whose catalogue does not know the table goes on with the files; other files are never erased."""
    path = f"{common.shared_dir(spark)}/digests"
    digests = lambda rows: exact_dedup.text_digests(spark.createDataFrame(rows, "doc_id long, text string"))
    first = exact_dedup.DigestIndex(spark, "codexloom_kept", buckets=3, path=path)
    assert first.append(digests([(1, "a"), (2, "b")])).count() == 2
    spark.sql("DROP TABLE codexloom_kept")  # an external table: its files stay
    later = exact_dedup.DigestIndex(spark, "codexloom_kept_on", buckets=5, path=path)
    assert sorted(r["keep_id"] for r in later.append(digests([(5, "A"), (6, "c")])).collect()) == [6]
    assert sorted(r["keep_id"] for r in later.read().collect()) == [1, 2, 6] and later.buckets == 3
    assert sorted((r["doc_id"], r["keep_id"]) for r in later.resolve(digests([(5, "A"), (7, "c")])).collect()) == [(5, 1), (7, 6)]
    spark.sql("DROP TABLE codexloom_kept_on")
    other = f"{common.shared_dir(spark)}/other"
    spark.range(3).write.parquet(other)
    with pytest.raises(ValueError, match="no digest index"):
        exact_dedup.DigestIndex(spark, "codexloom_other", path=other).append(digests([(1, "a")]))
    assert spark.read.parquet(other).count() == 3


def test_index_takes_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    batch = lambda *x: exact_dedup.text_digests(spark.createDataFrame(x, "doc_id long, text string"))
    assert sorted(r["keep_id"] for r in index.append(batch((1, "A"), (2, "a"), (3, "b"))).collect()) == [2, 3]
    assert sorted(r["keep_id"] for r in index.append(batch((9, "a"), (10, "c"), (11, None))).collect()) == [10, 11]
    assert index.append(batch().limit(0)).count() == 0 and index.read().count() == 4
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in index.resolve(batch((9, "a"), (11, ""))).collect()}
    assert got == {9: (2, 1), 11: (11, 1)}
    plan = batch((1, "A")).groupBy("digest").agg(F.max("doc_id").alias("k")).hint("merge").join(index.read().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 3 out of 3" in plan


def test_exact_dedup_of_awkward_documents(spark, awkward):
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(awkward).collect()]
    digest = [hashlib.sha256(lower(t).encode()).hexdigest() for _, t, *_ in AWKWARD]
    size = Counter(digest)
    top = {h: max((d if d is not None else -1) for (d, *_), x in zip(AWKWARD, digest) if x == h) for h in size}
    key = lambda r: str(r)
    want = [(d, None if top[h] == -1 else top[h], size[h], (d if d is not None else -1) == top[h], h) for (d, *_), h in zip(AWKWARD, digest)]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("room", [1 << 20, 0])
def test_line_dedup_of_awkward_documents(spark, awkward, room):
    again = "A line of more than forty characters, again."
    more = spark.createDataFrame([(20 + i, f"own {i}\n  {again.upper()}\t\nend", "en", 1, "k") for i in range(5)], SCHEMA)
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.drop_repeated_lines(awkward.unionByName(more), broadcast_bytes=room, per_shard=2).collect()}
    assert {x for x in got if x[0] == 8 or (x[0] or 0) >= 20} == {(8, 3, 3, "")} | {(20 + i, 3, 1, f"own {i}\nend") for i in range(4)} | {(24, 3, 0, f"own 4\n  {again.upper()}\t\nend")}
    assert {(x[0], x[1]) for x in got} >= {(None, 1), (1, 1), (2, 1), (3, 2)} and len(got) == 14


def test_perfect_hash():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 5000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        n = len(keys)
        # the second half repeats 64 bits of the first half, once as key and once as print
        prints = rng.integers(-(1 << 62), 1 << 62, n)
        keys, prints = np.concatenate((keys, keys)), np.concatenate((prints, rng.integers(-(1 << 62), 1 << 62, n)))
        prints[:n // 2] = 7
        index = line_dedup.LineIndex(keys, prints, np.arange(2 * n) * 2, np.arange(2 * n) * 3)
        index = pickle.loads(pickle.dumps(index, protocol=5))
        found, count, ids = index.probe(keys, prints)
        assert found.all() and (count == np.arange(2 * n) * 2).all() and (ids == np.arange(2 * n) * 3).all()
        assert not index.probe(rng.integers(0, 1 << 62, 1000), np.full(1000, -1))[0].any()
    assert not hasattr(index, "keys")


@pytest.mark.parametrize("room", [1 << 20, 0])
@pytest.mark.parametrize("at_least", [2, 3, 5])
def test_lines_against_brute_force(spark, room, at_least):
    rng = np.random.default_rng(at_least)
    line = lambda i: f"  Shared Line number {i} with more than forty characters \t"
    docs = [(int(rng.integers(60)), "\n".join(line(int(i)) if i < 30 else f"own {i}" for i in rng.integers(0, 60, 12))) for _ in range(80)] + [(None, line(1)), (None, line(1)), (99, line(2) + "\n" + line(2).upper())]
    key = lambda x: lower(x.strip(" \t"))
    held = {}
    for d, t in docs:
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(-1 if d is None else d)
    want = []
    for d, t in docs:
        lost = lambda x: len(held.get(key(x), ())) >= at_least and max(held[key(x)]) != (-1 if d is None else d)
        stay = [x for x in t.split("\n") if not lost(x)]
        want.append((str(d), "\n".join(stay), len(t.split("\n")), len(t.split("\n")) - len(stay)))
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_docs=at_least, broadcast_bytes=room, per_shard=8).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in got) == sorted(want)


# decontamination

def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(6)
    for top in (1, 2, 30):
        seq = np.concatenate([np.append(rng.integers(1, top + 1, rng.integers(1, 60)), 0) for _ in range(20)])
        index = decontaminate.FMIndex(seq, top)
        for n in (1, 2, 5):
            phrases = rng.integers(1, top + 1, (30, n))
            which, lo, hi = index.search(phrases)
            got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi)}
            want = {i: at for i, p in enumerate(phrases) if (at := [k for k in range(len(seq) - n + 1) if (seq[k:k + n] == p).all()])}
            assert got == want


def test_leaks_of_awkward_tables(spark, awkward):
    bench = spark.createDataFrame([(1, "SAME text"), (2, None), (3, "..."), (4, "same-text"), (None, "words long words long words long words long words long")], "item_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), sorted(r["items"])) for r in decontaminate.leaks(awkward, bench).collect())
    assert (4, 4, 2, ["1", "4"]) in got and (1, 0, 0, []) in got and (7, 60_000, 59_998, [""]) in got and len(got) == 10
    many = sorted((r["doc_id"] or -1, r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), sorted(r["items"])) for r in decontaminate.leaks(awkward, bench, block=1, shard=10).collect())
    assert many == got
    assert decontaminate.leaks(awkward, bench.limit(0)).where(F.size("spans") > 0).count() == 0
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_leaks(awkward, bench).collect()}
    assert cut[4] == "\n é here" and cut[2] == "" and cut[1] is None


# encoding

@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_tiktoken(encoding):
    path, pattern, own = encoding
    codec = bpe.Codec(bpe.sentencepiece_model(bpe.read_ranks(path)), pattern, cache=50)
    rng = np.random.default_rng(8)
    texts = ["", " ", "\n\n  x", "<|endoftext|>", "日本語 text 😀\x00\t", "a" * 5000, "▁ <unk> <s>"] + ["".join(chr(c) for c in rng.choice([*range(32, 127), *range(160, 0x500), *range(0x4e00, 0x4f00), 0x1F600], 200)) for _ in range(60)]
    for t in texts:
        raw = codec.encode(t)
        assert np.frombuffer(raw, "<u4").tolist() == own.encode_ordinary(t)
        assert codec.decode(raw) == t.encode()


def test_encoding_of_awkward_documents(spark, awkward, encoding):
    path, pattern, own = encoding
    got = bpe.bpe_encode(awkward, path, pattern).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        assert r["decoded"] == (r["text"] or "") and list(r["ids"]) == own.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(r["ids"])


def test_ids_of_all_documents(spark, documents, encoding):
    own, want = encoding[2], {}
    for d, t in documents.items():
        ids = own.encode_ordinary(t)
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registry.QUERIES["op10_bpe"](spark, SF).collect()}
    assert got == want


def test_scores_of_all_documents(spark, documents):
    """The query's scores are those of a machine fitted in plain Python on the same labels."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    known = sorted((int(d), int(q)) for d, q in zip(labels.doc_id, labels.quality) if q == q and zlib.crc32(str(int(d)).encode()) % 5)
    assert len(known) <= quality.SAMPLE
    words, dense = np.zeros((len(known), quality.BUCKETS), np.float32), []
    for k, (d, _) in enumerate(known):
        _, bucket, counts, own = quality.word_features([documents[d].encode()])
        words[k, bucket] = counts
        dense.append(own[0])
    machine = quality.fit(words, np.array(dense), np.array([q for _, q in known]))
    want = {d: machine.score([t.encode()])[0] for d, t in documents.items()}
    got = {r["doc_id"]: r for r in registry.QUERIES["op6_quality"](spark, SF).collect()}
    assert set(got) == set(want)
    for d, r in got.items():
        assert r["score"] == pytest.approx(want[d], abs=1e-6) and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)


# all of them

CLASHES = ["_row", "_lost", "n_removed", "n_lines", "n_dropped", "_drop", "score", "spans", "n_replaced", "ids", "decoded", "n_tokens", "_rest", "rest", "found", "new", "_salt", "key", "root", "kept", "fp",
           "bands", "h", "hash", "sides", "digest", "a.b", "with space"]


def _clashing(spark):
    """The awkward table with a column of every name that an operator uses inside or returns."""
    values = [F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES]
    return spark.createDataFrame([x[:3] for x in AWKWARD], "doc_id long, text string, lang string").select("doc_id", *values[:14], "text", *values[14:], "lang")


def _with_outputs(spark, apply, outputs):
    """Rows of an operator, after checking that all columns but its own came through."""
    docs = _clashing(spark)
    got = apply(docs)
    own = [c for c in docs.columns if c not in outputs]
    assert got.columns == [*own, *outputs]
    rows_ = got.collect()
    key = lambda r: (str(r["doc_id"]), str(r["lang"]))
    extra = [c for c in own if c != "text"]
    assert sorted([tuple(str(r[c]) for c in extra) for r in rows_]) == sorted([tuple(str(r[c]) for c in extra) for r in docs.collect()])
    none = apply(docs.limit(0))
    assert none.columns == got.columns and none.count() == 0
    return sorted(rows_, key=key)


@pytest.fixture(scope="module")
def awkward_texts():
    return sorted((str(d), str(lang), t) for d, t, lang, *_ in AWKWARD)


def test_clashes_pii(spark, awkward_texts):
    got = _with_outputs(spark, pii.pseudonymise, ["n_replaced"])
    assert [(str(r["doc_id"]), str(r["lang"]), r["text"]) for r in got] == awkward_texts and {r["n_replaced"] for r in got} == {0}


def test_clashes_paragraphs(spark):
    got = _with_outputs(spark, lambda d: paragraphs.drop_near_paragraphs(d, min_run=16), ["n_removed"])
    # document 8 repeats a line of eight words, documents 4 to 6 have fewer than five
    line = "A line of more than forty characters, again."
    assert {str(r["doc_id"]): (r["text"], r["n_removed"]) for r in got if r["n_removed"]} == {"8": (line, 2)}
    assert {str(r["doc_id"]): r["text"] for r in got if str(r["doc_id"]) in ("1", "2", "3", "None")} == {"1": None, "2": "", "3": " \n\t", "None": "x y z"}


def test_clashes_quality(spark, awkward_texts):
    machine = quality.train(_clashing(spark), spark.createDataFrame([(4, 1), (7, 0), (8, 1), (1, 0), (2, 0)], "doc_id long, quality int"))
    got = _with_outputs(spark, lambda d: quality.score_documents(d, machine), ["score"])
    want = machine.score([(t or "").encode() for _, _, t in awkward_texts])
    assert [(str(r["doc_id"]), str(r["lang"]), r["text"]) for r in got] == awkward_texts and [r["score"] for r in got] == pytest.approx(list(want))


@pytest.mark.parametrize("room", [1 << 20, 0])
def test_clashes_lines(spark, room):
    got = _with_outputs(spark, lambda d: line_dedup.drop_repeated_lines(d, broadcast_bytes=room), ["n_lines", "n_dropped"])
    assert [(r["n_lines"], r["n_dropped"]) for r in got] == [(len((t or "").split("\n")), 0) for _, _, t in sorted((str(d), str(lang), t) for d, t, lang, *_ in AWKWARD)]
    assert all(r["text"] is not None for r in got)


def test_clashes_leaks(spark):
    bench = spark.createDataFrame([(1, "same text"), (2, "long words long words long words long words long words")], "item_id long, text string")
    got = {(str(r["doc_id"]), r["text"]) for r in _with_outputs(spark, lambda d: decontaminate.remove_leaks(d, bench), [])}
    assert {x for x in got if x[0] in ("4", "5", "6")} == {("4", "\n é here"), ("5", "\n é here"), ("6", "\n É here")} and ("1", None) in got and ("None", "x y z") in got
    assert [t.strip() for d, t in got if d == "7"] == [""]


def test_clashes_ids(spark, encoding):
    path, pattern, own = encoding
    got = _with_outputs(spark, lambda d: bpe.bpe_encode(d, path, pattern), ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])
    for r in got:
        ids = own.encode_ordinary(r["text"] or "")
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and r["decoded"] == (r["text"] or "") and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_clashes_where_columns_are_ignored(spark, awkward):
    docs = _clashing(spark)
    for apply in (simhash.near_duplicates, exact_dedup.exact_dedup, suffix_dedup.remove_repeats, lambda d: decontaminate.leaks(d, docs.select(F.col("doc_id").alias("item_id"), "text"))):
        plain = docs.select("doc_id", "text")
        assert sorted(map(str, apply(docs).collect())) == sorted(map(str, apply(plain).collect())) and len(apply(docs.limit(0)).collect()) == 0


@pytest.mark.parametrize("apply", [
    pii.pseudonymise, paragraphs.drop_near_paragraphs, simhash.near_duplicates, suffix_dedup.remove_repeats, exact_dedup.exact_dedup, line_dedup.drop_repeated_lines])
def test_awkward_and_empty_tables(spark, awkward, apply):
    assert apply(awkward).count() == len(AWKWARD)
    assert apply(awkward.limit(0)).count() == 0


def test_simhash_of_awkward_documents(spark, awkward):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(awkward).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)} <= got

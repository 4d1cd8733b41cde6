"""Pseudonyms against a restatement in Python, and texts made to exhaust a pattern matcher."""

import datetime
import hashlib
import time

import pytest

from plumbline.llm.pii import pseudonymise

KEY = "k"


def feistel(left, right, m, n, kind):
    """Ten keyed rounds; even ones move the left half by the right one, odd ones the right half by the left one."""
    for turn in range(10):
        told = "|".join(map(str, (KEY, kind, m, n, turn, right if turn % 2 == 0 else left)))
        value = int(hashlib.sha256(told.encode()).hexdigest()[:15], 16)
        if turn % 2 == 0:
            left = (left + value) % m
        else:
            right = (right + value) % n
    return left, right


def symbols(text, base, kind):
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"

    def put(value, size):
        out = ""
        for _ in range(size):
            value, d = divmod(value, base)
            out = digits[d] + out
        return out

    n = len(text)
    if n == 1:
        a, b = {10: (2, 5), 36: (6, 6)}[base]
        left, right = feistel(*divmod(int(text, base), b), a, b, kind)
        return put(left * b + right, 1)
    blocks, out = -(-n // 20), ""
    for k in range(blocks):
        block = text[n * k // blocks : n * (k + 1) // blocks]
        u, v = len(block) // 2, len(block) - len(block) // 2
        left, right = feistel(int(block[:u], base), int(block[u:], base), base**u, base**v, kind)
        out += put(left, u) + put(right, v)
    return out


def luhn(payload):
    total = sum(sum(divmod(int(c) * (2 if k % 2 == 0 else 1), 10)) for k, c in enumerate(reversed(payload)))
    return str(-total % 10)


def date(text):
    first = datetime.date(1900, 1, 1)
    n = (datetime.date.fromisoformat(text) - first).days
    left, right = feistel(n % 271, n // 271, 271, 271, "date")
    return str(first + datetime.timedelta(left + 271 * right))


def ip(text):
    a, b, c, d = map(int, text.split("."))
    left, right = feistel(a * 256 + b, c * 256 + d, 1 << 16, 1 << 16, "ip")
    return ".".join(map(str, (*divmod(left, 256), *divmod(right, 256))))


def ssn(text):
    area, group, serial = map(int, text.split("-"))
    left, right = feistel((area - 1 if area < 666 else area - 2) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
    new = left // 99
    return f"{new + (1 if new < 665 else 2):03}-{left % 99 + 1:02}-{right + 1:04}"


def mapped(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [r.text for r in pseudonymise(rows, KEY).orderBy("id").collect()]


def test_pseudonyms_equal_their_restatement(spark):
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(k) for k in [*range(0, 73049, 37), 73048]]
    cases = [(str(d), date(str(d))) for d in days]
    cases += [(f"10.{k}.7.{k * 3 % 256}", ip(f"10.{k}.7.{k * 3 % 256}")) for k in range(0, 256, 9)]
    cases += [(x, ssn(x)) for x in ("001-01-0001", "665-99-9999", "667-10-1000", "899-99-9999")]
    for payload in ("411111111111111", "37828224631000", "601111111111111", "411111111111111111"):
        new = symbols(payload, 10, "card")
        cases.append((payload + luhn(payload), new + luhn(new)))
    for name in ("a", "z", "ab", "abc", "john.smith", "x" * 21, "q1w2e3r4t5" * 6):
        flat = iter(symbols(name.replace(".", ""), 36, "email"))
        cases.append((f"{name}@example.org", "".join(c if c == "." else next(flat) for c in name) + "@example.org"))
    got = mapped(spark, [f"on {x} or" for x, _ in cases])
    assert got == [f"on {y} or" for _, y in cases]
    moved = {(datetime.date.fromisoformat(b) - datetime.date.fromisoformat(a)).days for a, b in cases[: len(days)]}
    assert len(moved) > 1000 and len({b for _, b in cases[: len(days)]}) == len(days)


def test_one_letter_names_are_permuted_not_shifted(spark):
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    got = [x.split("@")[0] for x in mapped(spark, [f"{c}@x.org" for c in letters])]
    assert sorted(got) == sorted(letters)
    assert len({(letters.index(b) - letters.index(a)) % 36 for a, b in zip(letters, got)}) > 5


@pytest.mark.parametrize(
    "text",
    [
        "x@" + "a." * 500_000, "a." * 500_000, "a@" * 300_000, "a%" * 500_000, "-" * 1_000_000 + "a@b.org", "a" * 1_000_000 + "@b.org", "a-" * 500_000, "x@" + "a" * 1_000_000, "x@" + "a-" * 500_000 + ".org",
        "1-" * 300_000, "1." * 500_000, "1" * 1_000_000, "1 " * 100_000, "4111 " * 60_000, "12/" * 300_000, "(12) " * 100_000, "+1 " * 200_000, "AB12 " * 100_000, "@" * 1_000_000, "/" * 1_000_000,
    ],
    ids=range(20),
)
def test_long_texts_end(spark, text):
    began = time.time()
    out = mapped(spark, [text, "me@example.org"])
    assert len(out[0]) == len(text) and out[1] != "me@example.org" and time.time() - began < 60


def test_clashing_columns_stay(spark):
    rows = spark.createDataFrame([(1, "me@example.org", 9, 8, 7)], "id long, text string, n_pseudonyms int, _found int, _CUT int")
    (row,) = pseudonymise(rows, KEY).collect()
    assert (row.n_pseudonyms, row.n_pseudonyms_, row._found, row._CUT) == (9, 1, 8, 7) and row.text.endswith("@example.org")


def test_mail_beside_punctuation(spark):
    got = mapped(spark, ["john@x.org", "-john@x.org", "..john@x.org.", "<john@x.org>", "john@x.org.5"])
    name = got[0].split("@")[0]
    assert got == [f"{name}@x.org", f"-{name}@x.org", f"..{name}@x.org.", f"<{name}@x.org>", f"{name}@x.org.5"]

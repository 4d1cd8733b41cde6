"""Personal data as format-preserving pseudonyms, in SQL functions only.

Candidates are found by one pattern, validated (check digits, ranges, calendars) and permuted by a keyed Feistel
network over exactly the values of their format: a card stays a card with a right check digit, a date a date.
IBANs and cards are validated before, at every extent they may have, and marked, so that a number or word beside
them is neither taken along nor hidden from the other kinds.
Equal values have equal pseudonyms wherever they stand, and different values of a format never collide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())

#: A label of a host name. A match may end inside a host of very many labels: hosts stay as they are.
_LABEL = "[A-Za-z0-9][A-Za-z0-9-]*+(?<!-)"
#: Kinds in the order in which they are tried; each pattern has no capturing group of its own. Repetitions of groups
#: are bounded or possessive: the matcher recurses for others, and a long text would exhaust its stack.
PATTERNS = {
    "email": rf"(?<![\w.+%-])(?=[._%+-]*+[A-Za-z0-9])[A-Za-z0-9._%+-]{{1,64}}+@{_LABEL}(?:\.{_LABEL}){{0,20}}\.[A-Za-z]{{2,}}+",
    "iban": rf"(?<![\w])(?:(?:{_IBANS})(?!\w)|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?!\w)",
    "date": r"(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-]|\.[0-9])",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-][0-9])",
    "phone": r"(?<![\w.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?!\w|[.-][0-9])",
}
LIKELY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A row's mark is its text's MD5 in these characters, which are none: no text holds its own.
_MARKS = "".join(map(chr, range(0xFDD0, 0xFDE0)))
_EDGE = f"[{_MARKS[0]}-{_MARKS[-1]}]"
#: Four numbers of four digits that are no card are no phone either.
_FOURS = r"(?<![\w.-])[0-9]{4}(?:[ -][0-9]{4}){3}(?![\w]|[.-][0-9])"
ANY = "|".join(f"(?<={_EDGE})(?:{p})(?={_EDGE})|{_FOURS}" if kind == "card" else f"(?:{p})" for kind, p in PATTERNS.items())
#: Numbers with one blank or hyphen between them, 13 digits or more; none of them ends inside a word, a decimal or an address.
_AFTER = r"(?![\w]|\.[0-9]|[\w.%+-]{0,64}+@|-[0-9]+(?:[A-Za-z_]|\.[0-9]))"
RUN = rf"(?<![\w.-])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++{_AFTER}(?:[ -][0-9]++{_AFTER})*+"
#: Dates from FIRST_DAY to 2101-01-27 count: as many days as the square of DAYS_SIDE, so both halves weigh the same.
FIRST_DAY, DAYS_SIDE = "1900-01-01", 271
#: How the values of one symbol are cut in two halves, by base.
_ONE = {10: (2, 5), 36: (6, 6)}


#: Numbers of a run that are gone through at a time.
_BLOCK = 512


def _whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once and stands once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str) -> Column:
    """Permutes struct(l, r) within 0 <= l < left_size, 0 <= r < right_size: halves take turns to add, modulo
    their size, a keyed hash of the other half. The sizes are part of the hash: formats don't influence each other."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(at: Column, turn: Column) -> Column:
        told = F.concat_ws("|", F.lit(key), F.lit(kind), left_size.cast("string"), right_size.cast("string"), turn.cast("string"), F.when(turn % 2 == 0, at["r"]).otherwise(at["l"]).cast("string"))
        value = F.conv(F.substring(F.sha2(told, 256), 1, 15), 16, 10).cast("long")
        moves_left = F.struct(((at["l"] + F.pmod(value, left_size)) % left_size).alias("l"), at["r"].alias("r"))
        moves_right = F.struct(at["l"].alias("l"), ((at["r"] + F.pmod(value, right_size)) % right_size).alias("r"))
        return F.when(turn % 2 == 0, moves_left).otherwise(moves_right)

    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), start, step)


def _power(base: int, n: Column) -> Column:
    """base ** n, exactly, for n from 0 to 10."""
    return F.element_at(F.array(*[F.lit(base**k).cast("long") for k in range(11)]), n + 1)


def _number(symbols: Column, base: int) -> Column:
    return F.when(F.length(symbols) == 0, F.lit(0).cast("long")).otherwise(F.conv(symbols, base, 10).cast("long"))


def _symbols(value: Column, n: Column, base: int) -> Column:
    return F.when(n == 0, F.lit("")).otherwise(F.lpad(F.lower(F.conv(value.cast("string"), 10, base)), n, "0"))


def permute_symbols(text: Column, base: int, key: str, kind: str) -> Column:
    """Permutes strings of digits (base 10) or of digits and small letters (base 36) of the same length: blocks of
    2 to 20 symbols, as equal in length as can be, each by a Feistel network over its two halves; a string of one
    symbol by one over two factors of the base."""

    def one(block: Column) -> Column:
        def cut(u: Column) -> Column:
            v = F.length(block) - u
            out = feistel(_number(F.substring(block, F.lit(1), u), base), _number(F.substring(block, u + 1, v), base), _power(base, u), _power(base, v), key, kind)
            return let(out, lambda x: F.concat(_symbols(x["l"], u, base), _symbols(x["r"], v, base)))

        return let(F.floor(F.length(block) / 2).cast("int"), cut)

    def alone(symbol: Column) -> Column:
        left, right = _ONE[base]
        out = let(_number(symbol, base), lambda n: feistel(F.floor(n / right), n % right, F.lit(left), F.lit(right), key, kind))
        return let(out, lambda x: _symbols(x["l"] * right + x["r"], F.lit(1), base))

    def all_blocks(t: Column) -> Column:
        n, blocks = F.length(t), F.ceil(F.length(t) / 20).cast("int")
        begin = lambda k: F.floor(n * k / blocks).cast("int")
        each = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: let(F.substring(t, begin(k) + 1, begin(k + 1) - begin(k)), one))
        return F.when(n <= 0, t).when(n == 1, alone(t)).otherwise(F.array_join(each, ""))

    return let(text, all_blocks)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: F.length(c) > 0)


def _pour(form: Column, symbols: Column, slot: str) -> Column:
    """form with its slots (characters that match the class `slot`), in order, replaced by the symbols."""

    def pour(told: Column) -> Column:
        def step(a: Column, c: Column) -> Column:
            filled = F.struct(F.concat(a["out"], F.substring(told, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))
            return F.when(c.rlike(slot), filled).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at")))

        return F.aggregate(_chars(form), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda a: a["out"])

    return let(symbols, pour)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that the payload's digits call for."""
    doubled = F.transform(_chars(F.reverse(payload)), lambda c, k: let(c.cast("int") * F.when(k % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return ((F.lit(10) - F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10) % 10).cast("string")


def _card(x: Column, key: str) -> Column:
    def checked(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        moved = let(permute_symbols(payload, 10, key, "card"), lambda new: F.concat(new, luhn_digit(new)))
        return F.when(F.substring(d, -1, 1) == luhn_digit(payload), _pour(x, moved, "[0-9]"))

    return let(_digits(x), checked)


def mod97(text: Column) -> Column:
    """Remainder by 97 of capital letters and digits read as a number (A is 10)."""
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _good_iban(flat: Column) -> Column:
    rest = F.substring(flat, F.lit(5), F.length(flat))
    return (mod97(F.concat(rest, F.substring(flat, 1, 4))) == 1) & (F.length(flat) >= 15) & rest.rlike("[0-9]")


def _iban(x: Column, key: str) -> Column:
    def checked(flat: Column) -> Column:
        rest = F.substring(flat, F.lit(5), F.length(flat))
        country = F.substring(flat, 1, 2)

        def with_check(moved: Column) -> Column:
            check = F.lpad((F.lit(98) - mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
            return _pour(x, F.concat(country, check, moved), "[A-Z0-9]")

        return F.when(_good_iban(flat), let(_pour(rest, permute_symbols(_digits(rest), 10, key, "iban"), "[0-9]"), with_check))

    return let(F.regexp_replace(x, " ", ""), checked)


def _date(x: Column, key: str) -> Column:
    """Year first, or day first; where day first is no date, month first with slashes."""
    parsed = lambda *parts: F.try_to_timestamp(F.concat_ws("-", *[F.substring(x, a, n) for a, n in parts]), F.lit("yyyy-MM-dd")).cast("date")
    year_first, slashes = x.rlike(r"\A[0-9]{4}"), x.contains("/")
    day_first = parsed((7, 4), (4, 2), (1, 2))
    read = F.when(year_first, F.struct(parsed((1, 4), (6, 2), (9, 2)).alias("day"), F.when(slashes, "yyyy/MM/dd").otherwise("yyyy-MM-dd").alias("form"))).otherwise(
        F.when(day_first.isNotNull(), F.struct(day_first.alias("day"), F.when(slashes, "dd/MM/yyyy").otherwise("dd.MM.yyyy").alias("form"))).when(
            slashes, F.struct(parsed((7, 4), (1, 2), (4, 2)).alias("day"), F.lit("MM/dd/yyyy").alias("form"))
        )
    )

    def moved(found: Column) -> Column:
        def permuted(n: Column) -> Column:
            out = feistel(n % DAYS_SIDE, F.floor(n / DAYS_SIDE), F.lit(DAYS_SIDE), F.lit(DAYS_SIDE), key, "date")
            day = F.date_add(F.to_date(F.lit(FIRST_DAY)), let(out, lambda o: (o["l"] + DAYS_SIDE * o["r"]).cast("int")))
            text = let(day, lambda d: F.coalesce(*[F.when(found["form"] == form, F.date_format(d, form)) for form in ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy")]))
            return F.when((n >= 0) & (n < DAYS_SIDE**2), text)

        return let(F.datediff(found["day"], F.to_date(F.lit(FIRST_DAY))), permuted)

    return let(read, moved)


def _ip(x: Column, key: str) -> Column:
    def checked(part: Column) -> Column:
        at = lambda k: F.element_at(part, k)
        out = feistel(at(1) * 256 + at(2), at(3) * 256 + at(4), F.lit(1 << 16), F.lit(1 << 16), key, "ip")
        octets = lambda o: F.concat_ws(".", *[n.cast("long").cast("string") for n in (F.floor(o["l"] / 256), o["l"] % 256, F.floor(o["r"] / 256), o["r"] % 256)])
        return F.when(F.forall(part, lambda p: p <= 255), let(out, octets))

    return let(F.transform(F.split(x, r"\."), lambda p: p.cast("long")), checked)


def _ssn(x: Column, key: str) -> Column:
    area, group, serial = (F.substring(x, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    rank = F.when(area < 666, area - 1).otherwise(area - 2)  # 898 areas: 001 to 899 without 666
    out = feistel(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def text(o: Column) -> Column:
        new = F.floor(o["l"] / 99).cast("long")
        return F.concat_ws("-", F.lpad((new + F.when(new < 665, 1).otherwise(2)).cast("string"), 3, "0"), F.lpad((o["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((o["r"] + 1).cast("string"), 4, "0"))

    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), let(out, text))


def _phone(x: Column, key: str) -> Column:
    """All digits but those of a country code are permuted; brackets, blanks and signs stay."""
    head = F.regexp_extract(x, r"\A\+[0-9]{1,3}(?=[ .(-])", 0)

    def rest(tail: Column) -> Column:
        return let(_digits(tail), lambda d: F.when(F.length(d).between(7, 15), F.concat(head, _pour(tail, permute_symbols(d, 10, key, "phone"), "[0-9]"))))

    return let(F.substring(x, F.length(head) + 1, F.length(x)), rest)


def _email(x: Column, key: str) -> Column:
    """The letters and digits before the @ are permuted as symbols of base 36; capitals count as small letters."""
    local, host = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    symbols = F.lower(F.regexp_replace(local, "[^A-Za-z0-9]", ""))
    return F.concat(_pour(local, permute_symbols(symbols, 36, key, "email"), "[A-Za-z0-9]"), F.lit("@"), host)


KINDS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value; a value that no kind validates stays as it is."""
    return F.coalesce(*[F.when(value.rlike(_whole(PATTERNS[kind])), make(value, key)) for kind, make in KINDS.items()], value)


def _rebuilt(text: Column, pattern: str, make: Callable[[Column], Column]) -> Column:
    """text with what the pattern finds replaced by make of it."""
    found, parts = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)
    return let(parts, lambda p: F.concat(F.element_at(p, 1), F.array_join(F.zip_with(found, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.concat(make(a), b)), "")))


def _mark_cards(run: Column, mark: Column) -> Column:
    """run (see RUN) with the cards in it between marks: from the left, the longest extent with a right check digit.
    An extent holds whole numbers, all but its last of four digits or more; the longest one at the run's start may
    have any, unless it starts as a date or an SSN. None begins or ends at a hyphen."""

    def marked(part: Column) -> Column:
        def longest(i: Column) -> Column:
            def chosen(extents: Column) -> Column:
                def good(e: Column) -> Column:
                    grouped = ~e["s"].rlike("(?:^|[ -])[0-9]{1,3}[ -]")
                    loose = (i == 1) & (e["k"] == F.element_at(extents, 1)["k"]) & ~e["s"].rlike(rf"\A(?:{PATTERNS['date']}|{PATTERNS['ssn']})")
                    return (grouped | loose) & let(_digits(e["s"]), lambda d: F.substring(d, -1, 1) == luhn_digit(F.substring(d, F.lit(1), F.length(d) - 1)))

                return F.coalesce(F.get(F.filter(extents, good), F.lit(0))["k"], F.lit(0))

            lengths = F.sequence(F.least(F.lit(19), F.size(part) - i + 1), F.lit(1), F.lit(-1))
            extents = F.transform(lengths, lambda k: F.struct(k.alias("k"), F.array_join(F.slice(part, i, k), "").alias("s")))
            extents = F.filter(extents, lambda e: ~e["s"].endswith("-") & F.length(_digits(e["s"])).between(13, 19))
            begins = (i == 1) | F.element_at(part, F.greatest(i - 1, F.lit(1))).endswith(" ")
            return F.when(begins, let(extents, chosen)).otherwise(0)

        # per number: 1 if a card begins there, 2 if one ends, 3 both. Codes are gathered block by block: arrays are
        # copied whenever they grow, and a run may have as many numbers as the text has room for
        def step(a: Column, i: Column) -> Column:
            def taken(k: Column) -> Column:
                return F.struct((F.when(k > 0, i + k).otherwise(a["next"])).alias("next"), F.concat(a["codes"], F.array(F.when(k == 1, 3).when(k > 1, 1).otherwise(0))).alias("codes"))

            inside = F.struct(a["next"].alias("next"), F.concat(a["codes"], F.array(F.when(i + 1 == a["next"], 2).otherwise(0))).alias("codes"))
            return F.when(i < a["next"], inside).otherwise(let(longest(i), taken))

        none = F.array().cast("array<int>")

        def block(a: Column, k: Column) -> Column:
            numbers = F.sequence(k * _BLOCK + 1, F.least((k + 1) * _BLOCK, F.size(part)))
            done = F.aggregate(numbers, F.struct(a["next"].alias("next"), none.alias("codes")), step)
            return let(done, lambda d: F.struct(d["next"].alias("next"), F.concat(a["codes"], d["codes"]).alias("codes")))

        hits = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(part) - 1) / _BLOCK).cast("int")), F.struct(F.lit(1).alias("next"), none.alias("codes")), block, lambda a: a["codes"])
        edge = lambda code, bit: F.when(code.bitwiseAND(bit) > 0, mark).otherwise("")
        told = lambda codes: F.array_join(F.zip_with(part, codes, lambda t, c: F.concat(edge(c, 1), _digits(t), edge(c, 2), F.regexp_replace(t, "[0-9]", ""))), "")
        return let(hits, told)

    return let(F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), F.lit(0)), marked)


def marked(text: Column, mark: Column) -> Column:
    """text with valid IBANs and, outside them, valid cards between marks."""
    ibans = F.when(text.rlike(PATTERNS["iban"]), _rebuilt(text, PATTERNS["iban"], lambda v: F.when(_good_iban(F.regexp_replace(v, " ", "")), F.concat(mark, v, mark)).otherwise(v))).otherwise(text)
    outside = lambda x: F.when(x.rlike(RUN), _rebuilt(x, RUN, lambda v: _mark_cards(v, mark))).otherwise(x)
    return F.call_function("array_join", F.transform(F.split(ibans, mark, -1), lambda x, i: F.when(i % 2 == 0, outside(x)).otherwise(x)), mark)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_pseudonyms") -> DataFrame:
    """docs with the personal data in text_col replaced, and the number of replaced values in count_col.

    All other columns stay as they are, so does a null text (count 0); texts without personal data come back
    unchanged. If docs has a column named count_col already, that stays too, and the count's name gets as many
    underscores behind it as make it new. Repeated values, in one text or in many, get the same pseudonym. Mail names
    have 64 characters at most. Only SQL functions run: texts are cut at the candidates, these are mapped one by
    one, and the parts are joined again. No shuffle.
    """
    text = F.col(f"`{text_col}`")
    likely = text.rlike("[0-9@]") & text.rlike(LIKELY)
    taken = {c.lower() for c in docs.columns}

    def fresh(name: str) -> str:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        return name

    temp, cut = fresh("_found"), fresh("_cut")
    mark = F.translate(F.md5(text), "0123456789abcdef", _MARKS)
    # values are mapped in a column of their own, so that each is worked out once
    step = docs.withColumn(cut, F.when(likely, let(mark, lambda m: marked(text, m))))
    step = step.withColumn(temp, F.regexp_extract_all(F.col(cut), F.lit(f"({ANY})"), F.lit(1)))
    mapped = F.transform(F.col(temp), lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new")))
    step = step.withColumn(temp, mapped)
    parts = F.split(F.col(cut), ANY, -1)
    joined = F.concat(
        F.element_at(parts, 1),
        F.array_join(F.zip_with(F.col(temp)["new"], F.slice(parts, F.lit(2), F.size(parts)), lambda a, b: F.concat(a, b)), ""),
    )
    out = step.withColumn(text_col, F.when(F.col(temp).isNull(), text).otherwise(F.replace(joined, mark, F.lit(""))))
    if count_col is not None:
        out = out.withColumn(fresh(count_col), F.coalesce(F.size(F.filter(F.col(temp), lambda x: x["old"] != x["new"])), F.lit(0)).cast("long"))
    return out.drop(temp, cut)

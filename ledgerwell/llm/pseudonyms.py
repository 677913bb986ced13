"""PII pseudonyms by format-preserving Feistel permutations, in DataFrame expressions only.

Numbers that pass their check (card numbers: Luhn; account numbers: IBAN's mod 97; social security numbers and IPv4 addresses: their ranges; phone
numbers: their length; dates: the calendar) are permuted within their own format by a keyed Feistel network, so equal
values get equal pseudonyms in every document, different values different ones, and a pseudonym passes the same check.
The local parts of e-mail addresses are permuted letter for letter and digit for digit. What fails its check stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: What may be personal, in the order of trial. Every repetition is bounded or possessive.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<!\d)(?<!\d[.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
DATE_FORMATS = {
    r"^\d{4}-": ["yyyy-MM-dd"], r"^\d{4}/": ["yyyy/MM/dd"], r"^\d{2}\.\d{2}\.": ["dd.MM.yyyy"], r"^(?:\d\.|\d{2}\.\d\.)": ["d.M.yyyy"],
    r"^\d{2}/\d{2}/\d": ["dd/MM/yyyy", "MM/dd/yyyy"], r"^(?:\d/|\d{2}/\d/)": ["d/M/yyyy", "M/d/yyyy"],
}
#: Dates within DAYS_A * DAYS_B days from the first are permuted among themselves.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 256, 285
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def _hash(key: str, tweak: str, round_: Column, *parts: Column) -> Column:
    """Hex digits of a keyed hash of the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), round_.cast("string"), *[p.cast("string") for p in parts]), 256)


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def permute_number(value: Column, a: int, b: int, key: str, tweak: str) -> Column:
    """Permute 0 .. a * b - 1: value = x * b + y, and in turn one half grows by a keyed hash of the other, mod its size."""
    y0 = F.pmod(value.cast("long"), F.lit(b).cast("long"))
    start = F.struct(((value - y0) / F.lit(b)).cast("long").alias("x"), y0.alias("y"))

    def step(acc: Column, r: Column) -> Column:
        grown = lambda half, other, size: F.pmod(half + F.pmod(_number(F.left(_hash(key, tweak, r, other), F.lit(15))), F.lit(size).cast("long")), F.lit(size).cast("long"))
        even = r % 2 == 0
        return F.struct(F.when(even, grown(acc["x"], acc["y"], a)).otherwise(acc["x"]).alias("x"), F.when(~even, grown(acc["y"], acc["x"], b)).otherwise(acc["y"]).alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: acc["x"] * F.lit(b) + acc["y"])


def _shift(text: Column, stream: Column) -> Column:
    """Move each letter and digit within its own alphabet, by the stream's hex digits in turn."""

    def move(c: Column, i: Column) -> Column:
        by = _number(F.substr(stream, F.pmod(i * 3, F.lit(60)) + 1, F.lit(3)))
        moved = c
        for letters in ALPHABETS:
            at = F.instr(F.lit(letters), c)
            moved = F.when(at > 0, F.substr(F.lit(letters), (F.pmod(at - 1 + by, F.lit(len(letters))) + 1).cast("int"), F.lit(1))).otherwise(moved)
        return moved

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), move), "")


def permute_text(text: Column, key: str, tweak: str) -> Column:
    """Permute the letters and digits of a text within their alphabets, other characters stay; case-blind in the hash."""
    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.left(text, half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))

    def step(acc: Column, r: Column) -> Column:
        even, n = r % 2 == 0, F.length(acc["l"]) + F.length(acc["r"])
        return F.struct(F.when(even, _shift(acc["l"], _hash(key, tweak, r, n, F.lower(acc["r"])))).otherwise(acc["l"]).alias("l"), F.when(~even, _shift(acc["r"], _hash(key, tweak, r, n, F.lower(acc["l"])))).otherwise(acc["r"]).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced by `digits`, in order."""
    gaps = F.split(form, "[0-9]", -1)
    return F.array_join(F.zip_with(gaps, F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), lambda gap, d: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(d, F.lit("")))), "")


def luhn_sum(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = permute_text(F.left(digits, F.length(digits) - 1), key, "card")
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(F.pmod(luhn_sum(digits), F.lit(10)) == 0, _refill(m, F.concat(body, check.cast("string")))).otherwise(m)


def mod97(code: Column) -> Column:
    """Remainder by 97 of the number that digits and letters (A = 10 .. Z = 35) spell."""

    def add(acc: Column, c: Column) -> Column:
        letter = F.instr(F.lit(ALPHABETS[1]), c)
        return F.pmod(F.when(letter > 0, acc * 100 + letter + 9).otherwise(acc * 10 + F.instr(F.lit(ALPHABETS[2]), c) - 1), F.lit(97))

    return F.aggregate(F.regexp_extract_all(code, F.lit("[A-Z0-9]"), F.lit(0)), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    """The country stays, letters and digits of the account are permuted, the check digits are made anew."""
    code = F.regexp_replace(m, " ", "")
    country, account = F.left(code, F.lit(2)), F.substr(code, F.lit(5), F.length(code))
    moved = permute_text(account, key, "iban")
    check = F.lpad((98 - mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
    new = F.concat(country, check, moved)
    chars, gaps = F.regexp_extract_all(new, F.lit("[A-Z0-9]"), F.lit(0)), F.split(m, "[A-Z0-9]", -1)
    refilled = F.array_join(F.zip_with(gaps, chars, lambda gap, c: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(c, F.lit("")))), "")
    return F.when(F.length(code).between(15, 34) & (mod97(F.concat(account, F.left(code, F.lit(4)))) == 1), refilled).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The country code (of a number with a plus: up to the first gap, else two digits) stays."""
    country = F.when(F.startswith(m, F.lit("+")), F.coalesce(F.nullif(F.regexp_extract(m, r"^\+(\d{1,3})[ .(-]", 1), F.lit("")), F.substr(m, F.lit(2), F.lit(2)))).otherwise(F.lit(""))
    digits = _digits(m)
    local = F.substr(digits, F.length(country) + 1, F.length(digits))
    return F.when(F.length(digits).between(10, 15), _refill(m, F.concat(country, permute_text(local, key, "phone")))).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    moved = permute_number(index, 898, 99 * 9999, key, "ssn")
    part = lambda by, size: F.pmod(F.floor(moved / by), F.lit(size))
    new_area = part(99 * 9999, 898) + 1
    form = F.format_string("%03d-%02d-%04d", new_area + F.when(new_area >= 666, 1).otherwise(0), part(9999, 99) + 1, part(1, 9999) + 1)
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), form).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    part = [F.split(m, r"\.")[i].cast("long") for i in range(4)]
    moved = permute_number(((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3], 1 << 16, 1 << 16, key, "ip")
    new = F.concat_ws(".", *[F.pmod(F.shiftright(moved, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    canonical = F.concat_ws(".", *[p.cast("string") for p in part])
    return F.when((F.greatest(*part) < 256) & (canonical == m), new).otherwise(m)


def _date(m: Column, key: str) -> Column:
    out = m
    for start, formats in DATE_FORMATS.items():
        for form in reversed(formats):
            day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))
            new = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), permute_number(day, DAYS_A, DAYS_B, key, "date").cast("int")), form)
            out = F.when(F.rlike(m, F.lit(start)) & day.between(0, DAYS_A * DAYS_B - 1), new).otherwise(out)
    return out


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permute_text(local, key, "email"), F.substr(m, F.length(local) + 1, F.length(m)))


_MAKE = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(F.rlike(m, F.lit(f"^(?:{pattern})$")), F.lit(kind)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    out = m
    for name, make in _MAKE.items():
        out = F.when(kind == name, make(m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with `text` rewritten, and `replaced`: an array of (kind, pseudonym) in the order of the text.

    `key` is the caller's secret: who has it can undo the pseudonyms, and one key always gives the same ones. Whole texts
    are searched. A null text stays null with a null array; an empty one, or one without finds, stays as it is with an
    empty array. Repeated rows stay; an input column called replaced is replaced, others may have any name. Dates written
    with slashes are read as day/month/year if that is a date, else as month/day/year; dates of one-digit days or months
    may get longer or shorter by the digits of the new ones. Dates before 1900 or after 2099, numbers that fail their
    check and numbers in other forms than PATTERNS stay readable.
    """
    if not key:
        raise ValueError("a key is needed")
    keep = [c for c in docs.columns if c.lower() not in ("replaced",)]
    t = F.col(f"`{text}`")
    found = F.when(t.isNull(), None).when(F.rlike(t, F.lit("[0-9@]")), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # the caller's columns travel as one struct, so none of their names can clash with those made here
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.transform(found, lambda m: F.struct(m.alias("was"), kind_of(m).alias("kind"))).alias("found"))
    named = F.transform("found", lambda f: F.struct(f["was"].alias("was"), f["kind"].alias("kind"), pseudonym(f["was"], f["kind"], key).alias("pseudonym")))
    marked = marked.withColumn("found", F.when(F.size("found") > 0, named).otherwise(F.array().cast("array<struct<was:string,kind:string,pseudonym:string>>")))
    t = F.col("row")[text]
    parts = F.zip_with(F.split(t, ANY, -1), F.transform("found", lambda f: f["pseudonym"]), lambda p, n: F.concat(F.coalesce(p, F.lit("")), F.coalesce(n, F.lit(""))))
    new = F.when(F.size("found") > 0, F.array_join(parts, "")).otherwise(t)
    replaced = F.when(t.isNotNull(), F.transform(F.filter("found", lambda f: f["was"] != f["pseudonym"]), lambda f: F.struct(f["kind"].alias("kind"), f["pseudonym"].alias("pseudonym"))))
    return marked.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in keep], replaced.alias("replaced"))

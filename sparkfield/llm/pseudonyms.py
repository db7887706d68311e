"""Operator 4: format-preserving pseudonyms by keyed Feistel networks. DataFrame functions only.

Found, validated and replaced within their format:

========  ====================================  ==========================================
kind      validated by                          what is permuted
========  ====================================  ==========================================
email     shape                                 letters and digits of the local part
card      13 to 19 digits, Luhn sum             all digits but the first; new check digit
phone     ten digits, grouped by brackets or    the ten digits; at the front 0-1 stays 0-1
          separators, or with a country code    and 2-9 stays 2-9
ssn       area, group and serial in use         its number among the valid ones, 88902 * 9999
ip        four numbers up to 255                the 32-bit address
date      a day of the calendar (ISO,           the day within its 400 years, which are
          D.M.Y or M/D/Y with two-digit parts)  189 * 773 days
========  ====================================  ==========================================

Each permutation alternates between two halves: one half's symbols move, each within its
own alphabet, by a keyed hash of the other half. So it is a bijection whatever the
length, digits stay digits, and equal values get equal pseudonyms in all documents, with
or without separators. Numbers of which only some are valid are permuted by their
place among the valid ones, so that the result is valid. What does not validate stays as it is.

The key is a parameter of all functions here; the registered query and the pipeline read
it from the session's ``spark.sparkfield.pseudonym.key`` (:func:`session_key`).

Defined cases: a null text stays null; texts without a value stay as they are, byte for
byte; repeated rows get the same text; other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
KEY_SETTING = "spark.sparkfield.pseudonym.key"
DEFAULT_KEY = "not a secret: for tests"
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999  # 001 to 899 without 666, 01 to 99, 0001 to 9999
CYCLE_DAYS, CYCLE = 146097, (189, 773)  # days of 400 years

EMAIL = r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
DATE = r"(?<![\w./-])(?:\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\w/]|[.-]\d)"
IP = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)"
PHONE = (
    r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
    r"|\+\d{1,3}[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4})(?![\w]|[-.]\d)"
)
SSN = r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])"
CARD = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|-\d)"
ANY = "|".join((EMAIL, DATE, IP, PHONE, SSN, CARD))


def _full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _hash(key: str, *parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[F.lit(p) if isinstance(p, str) else p for p in parts]), 512)


def _number(digest: Column, at: Column | int = 0, width: int = 4) -> Column:
    """The number in ``width`` hex digits of a digest from place ``at``."""
    start = at + 1 if isinstance(at, Column) else F.lit(at + 1)
    return F.conv(F.substring(digest, start, F.lit(width)), 16, 10).cast("bigint")


def _symbols(text: Column, lead: int = 0) -> Column:
    """Value, first character and size of the alphabet of each character. The first ``lead`` ones are fixed."""

    def symbol(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        code = F.ascii(c)
        digit, upper, lower = c.between("0", "9"), c.between("A", "Z"), c.between("a", "z")
        base = F.when(i <= lead, code).when(digit, 48).when(upper, 65).when(lower, 97).otherwise(code)
        size = F.when(i <= lead, 1).when(digit, 10).when(upper | lower, 26).otherwise(1)
        return F.struct((code - base).alias("v"), base.alias("b"), size.alias("n"))

    return F.transform(F.sequence(F.lit(1), F.length(text)), symbol)


def permute_text(text: Column, key: str, kind: str, lead: int = 0) -> Column:
    """A bijection on the texts with the same character classes at the same places; ASCII, not empty."""
    half = F.floor(F.length(text) / 2).cast("int")

    def turn(state: Column, r: Column) -> Column:
        left = r % 2 == 1  # the left half moves
        other = F.filter(state, lambda s, i: (i < half) != left)
        digest = _hash(key, kind, r.cast("string"), F.array_join(F.transform(other, lambda s: s["v"].cast("string")), ","))

        def moved(d: Column) -> Column:
            def move(s: Column, i: Column) -> Column:
                new = ((s["v"] + _number(d, 4 * (i % 32))) % s["n"]).cast("int")
                return F.struct(F.when((i < half) == left, new).otherwise(s["v"]).alias("v"), s["b"].alias("b"), s["n"].alias("n"))

            return F.transform(state, move)

        return _let(digest, moved)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), _symbols(text, lead), turn)
    return F.array_join(F.transform(out, lambda s: F.char(s["v"] + s["b"])), "")


def permute_number(value: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """A bijection on 0 .. sizes[0] * sizes[1] - 1."""
    a, b = sizes
    start = F.struct(
        F.floor(value / b).cast("bigint").alias("x"), (value % b).cast("bigint").alias("y"), F.lit(a).cast("bigint").alias("m"), F.lit(b).cast("bigint").alias("n")
    )

    def turn(s: Column, r: Column) -> Column:
        moved = (s["x"] + _number(_hash(key, kind, r.cast("string"), s["y"].cast("string")), 0, 12)) % s["m"]
        return F.struct(s["y"].alias("x"), moved.alias("y"), s["n"].alias("m"), s["m"].alias("n"))

    # An even number of turns brings the halves back to their sides.
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["x"] * b + s["y"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _put_back(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced, in order."""

    def filled(new: Column) -> Column:
        def each(i: Column) -> Column:
            c = F.substring(text, i, F.lit(1))
            return F.when(c.between("0", "9"), F.substring(new, F.length(_digits(F.substring(text, F.lit(1), i))), F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), each), "")

    return _let(digits, filled)


def luhn_sum(digits: Column, weight_first: bool = False) -> Column:
    """The Luhn sum, doubling every second digit from the right, or from the last one if ``weight_first``."""

    def part(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.floor(2 * d / 10).cast("int") + (2 * d) % 10
        return F.when(i % 2 == (0 if weight_first else 1), twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), part), F.lit(0), lambda a, x: a + x)


def _email(text: Column, key: str) -> Column:
    at = F.instr(text, "@")
    # Symbols are looked at one by one, so the local part is cut off once.
    return F.concat(_let(F.substring(text, F.lit(1), at - 1), lambda v: permute_text(v, key, "email")), F.substring(text, at, F.length(text)))


def _card(text: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = permute_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", lead=1)
        # The check digit completes the sum, in which the body's last digit is doubled.
        whole = _let(body, lambda b: F.concat(b, ((10 - luhn_sum(b, weight_first=True) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, _put_back(text, whole))

    return _let(_digits(text), made)


def _phone(text: Column, key: str) -> Column:
    # The country code is what stands before the last ten digits.
    prefix = F.regexp_extract(text, r"^(?:\+\d{1,3}[ .-]?)?(?=(?:[^0-9]*[0-9]){10}$)", 0)
    rest = F.substring(text, F.length(prefix) + 1, F.length(text))

    def made(d: Column) -> Column:
        # The first digit moves within 0-1 or within 2-9, so numbers that can be dialled stay so.
        first = F.substring(d, 1, 1).cast("int")
        low, n = F.when(first < 2, 0).otherwise(2), F.when(first < 2, 2).otherwise(8)
        first = (first - low + _number(_hash(key, "phone first", F.substring(d, 2, 9)))) % n + low
        new = F.concat(first.cast("string"), _let(F.substring(d, 2, 9), lambda v: permute_text(v, key, "phone")))
        return F.concat(prefix, _let(rest, lambda v: _put_back(v, new)))

    return _let(_digits(rest), made)


def _dialled_phone(text: Column, key: str) -> Column:
    """Null for numbers with 0 or 1 in front of the ten digits."""
    return F.when(text.rlike(r"[2-9](?:[^0-9]*[0-9]){9}$"), _phone(text, key))


def _ssn_valid(text: Column) -> Column:
    return text.rlike(r"^(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}$")


def _ssn(text: Column, key: str) -> Column:
    area, group, serial = [p.cast("bigint") for p in (F.substring(text, 1, 3), F.substring(text, 5, 2), F.substring(text, 8, 4))]
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    number = (place * SSN_GROUPS + group - 1) * SSN_SERIALS + serial - 1
    new = permute_number(number, (SSN_AREAS * SSN_GROUPS, SSN_SERIALS), key, "ssn")

    def written(v: Column) -> Column:
        place = F.floor(v / (SSN_GROUPS * SSN_SERIALS))
        parts = (place + 1 + F.when(place >= 665, 1).otherwise(0), F.floor(v / SSN_SERIALS) % SSN_GROUPS + 1, v % SSN_SERIALS + 1)
        return F.concat_ws("-", *[F.lpad(p.cast("bigint").cast("string"), n, "0") for p, n in zip(parts, (3, 2, 4))])

    return F.when(_ssn_valid(text), _let(new, written))


def _ip(text: Column, key: str) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda p: p.cast("bigint"))
    value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p)
    new = permute_number(value, (1 << 16, 1 << 16), key, "ip")

    def octets(v: Column) -> Column:
        return F.concat_ws(".", *[(F.floor(v / (1 << s)) % 256).cast("bigint").cast("string") for s in (24, 16, 8, 0)])

    return F.when(~F.exists(parts, lambda p: p > 255), _let(new, octets))


def _date(text: Column, key: str) -> Column:
    iso, dots = text.rlike(r"^\d{4}-"), text.rlike(r"^\d\d\.")
    at = [F.when(iso, a).when(dots, b).otherwise(c) for a, b, c in ((1, 7, 7), (6, 4, 1), (9, 1, 4))]
    y, m, d = [F.substring(text, p, F.lit(n)) for p, n in zip(at, (4, 2, 2))]
    day = F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd")).cast("date")
    zero = F.lit("2000-01-01").cast("date")

    def moved(number: Column) -> Column:
        cycle = F.floor(number / CYCLE_DAYS).cast("bigint")
        return F.date_add(zero, (cycle * CYCLE_DAYS + permute_number(number - cycle * CYCLE_DAYS, CYCLE, key, "date")).cast("int"))

    def written(new: Column) -> Column:
        y, m, d = [F.lpad(part(new).cast("string"), n, "0") for part, n in ((F.year, 4), (F.month, 2), (F.dayofmonth, 2))]
        return F.when(iso, F.concat_ws("-", y, m, d)).when(dots, F.concat_ws(".", d, m, y)).otherwise(F.concat_ws("/", m, d, y))

    def made(number: Column) -> Column:
        return F.when(number.between(-2 * CYCLE_DAYS + 1, 2 * CYCLE_DAYS), _let(moved(number), written))

    return _let(F.datediff(day, zero).cast("bigint"), made)


KINDS = ((EMAIL, _email), (DATE, _date), (IP, _ip), (PHONE, _phone), (SSN, _ssn), (CARD, _card))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEFAULT_KEY)


def pseudonym(value: Column, key: str, dialled: bool = True) -> Column:
    """Of a found value; null if it does not validate, with ``dialled`` also if it is a phone number with 0 or 1 in front."""
    out = F.lit(None).cast("string")
    for pattern, make in reversed(KINDS):
        make = _dialled_phone if dialled and make is _phone else make
        out = F.when(value.rlike(_full(pattern)), make(value, key)).otherwise(out)
    return out


def with_pseudonyms(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with the values in ``column`` replaced."""
    names = [F.col("new.text").alias(column) if c == column else F.col(f"row.`{c}`") for c in docs.columns]
    return _replaced(docs, key, column).select(*names)


def _replaced(docs: DataFrame, key: str, column: str) -> DataFrame:
    """``row`` (all columns), ``new`` (text, n_replaced)."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col(f"row.`{column}`")
    found = row.withColumn("found", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    found = found.withColumn("given", F.transform("found", lambda v: pseudonym(v, key, dialled=False)))
    new = F.zip_with("found", "given", lambda v, g: F.coalesce(g, v))
    pieces = F.zip_with(F.split(text, ANY, -1), F.array_append(new, ""), lambda p, v: F.concat(p, v))
    some = F.size("found") > 0
    replaced = F.struct(
        F.when(some, F.array_join(pieces, "")).otherwise(text).alias("text"),
        F.when(some, F.size(F.filter("given", lambda g: g.isNotNull()))).otherwise(0).cast("long").alias("n_replaced"),
    )
    return found.select("row", replaced.alias("new"))


def op4_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return _replaced(docs, session_key(spark), "text").select("row.doc_id", "new.n_replaced", "new.text")

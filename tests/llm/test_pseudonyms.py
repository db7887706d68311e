import hashlib
import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from sparkfield.llm import pseudonyms as P


def digest(key, *parts):
    return hashlib.sha512("|".join((key, *map(str, parts))).encode()).hexdigest()


def text_permutation(text, key, kind, lead=0, sign=1):
    base, size = [], []
    for i, c in enumerate(text):
        b, n = (48, 10) if c.isdigit() else (65, 26) if c.isupper() else (97, 26) if c.islower() else (ord(c), 1)
        base.append(ord(c) if i < lead else b)
        size.append(1 if i < lead else n)
    v = [ord(c) - b for c, b in zip(text, base)]
    half = len(text) // 2
    for r in range(1, P.ROUNDS + 1) if sign > 0 else range(P.ROUNDS, 0, -1):
        left = r % 2 == 1
        d = digest(key, kind, r, ",".join(str(x) for i, x in enumerate(v) if (i < half) != left))
        v = [(x + sign * int(d[4 * (i % 32) :][:4], 16)) % size[i] if (i < half) == left else x for i, x in enumerate(v)]
    return "".join(chr(x + b) for x, b in zip(v, base))


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def card(rng, n=16):
    body = "".join(rng.choices("0123456789", k=n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def values(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    return [r.p for r in df.select(P.pseudonym(F.col("v"), P.DEFAULT_KEY).alias("p")).collect()]


def test_permutation_agrees_and_inverts(spark):
    rng = random.Random(1)
    texts = ["a", "Z9", "anna.b_42", "x" * 64, *{"".join(rng.choices("ab0", k=3)) for _ in range(30)}]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r.p for r in df.select(P.permute_text(F.col("v"), "k", "email").alias("p")).collect()]
    assert got == [text_permutation(t, "k", "email") for t in texts]
    assert [text_permutation(t, "k", "email", sign=-1) for t in got] == texts


def test_numbers_are_permuted(spark):
    n = 19 * 23
    row = spark.range(n).select(P.permute_number(F.col("id"), (19, 23), "k", "date").alias("p")).agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(row) == (n, 0, n - 1)


def test_cards(spark):
    rng = random.Random(2)
    cards = list({card(rng, n) for n in (13, 15, 16, 19) for _ in range(100)})
    new = values(spark, cards)
    assert all(luhn(p) and len(p) == len(c) and p[0] == c[0] and p != c for c, p in zip(cards, new))
    assert len(set(new)) == len(cards)
    assert values(spark, ["4111 1111 1111 1111"])[0].replace(" ", "-") == values(spark, ["4111-1111-1111-1111"])[0]
    assert values(spark, ["4111111111111112"]) == [None]


def test_dates_phones_addresses(spark):
    days = [(date(1999, 12, 1) + timedelta(k)).isoformat() for k in range(400)]
    new = values(spark, days)
    assert len(set(new)) == 400 and all(date.fromisoformat(d) for d in new)
    same = values(spark, ["2024-02-29", "29.02.2024", "02/29/2024", "2023-02-29", "31.04.2020"])
    y, m, d = same[0].split("-")
    assert same == [f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", None, None]
    phones = values(spark, ["+1 (982) 555-2127", "982-555-2127", "(182) 555-2127"])
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) \d{3}-\d{4}", phones[0]) and re.sub(r"\D", "", phones[0])[1:] == re.sub(r"\D", "", phones[1]) and phones[2] is None
    ips = values(spark, ["10.0.0.1", "255.255.255.255", "256.1.1.1"])
    assert all(0 <= int(o) < 256 for ip in ips[:2] for o in ip.split(".")) and ips[2] is None
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", values(spark, ["123-45-6789"])[0]) and values(spark, ["000-45-6789"]) == [None]


def test_texts(spark):
    clean = ["Version 2.0.\nBY-NC 4.0.", "", None, "1,2.5 and 3.4.5 v1.2.3.4.5 1234567890123456", "x@ y @z a@b", "password=e3b3ed3cc8548923d6", "é 汉 " * 4000]
    texts = [*clean, "mail a.b@x.org, card 4111111111111111. IP 10.1.2.3; (982) 555-2127 and a.b@x.org", "10.1.2.3"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, new int").withColumn("found", F.lit(2))
    out = P.with_pseudonyms(df, P.DEFAULT_KEY)
    assert out.columns == df.columns
    got = [r.text for r in out.orderBy("doc_id").collect()]
    assert got[: len(clean)] == clean
    assert re.fullmatch(r"mail ([a-z]\.[a-z]@x\.org), card 4\d{15}\. IP [\d.]+; \([2-9]\d\d\) \d{3}-\d{4} and \1", got[-2])
    assert got[-1] in got[-2] and "10.1.2.3" not in got[-2]
    assert P.with_pseudonyms(df.limit(0), P.DEFAULT_KEY).count() == 0


@pytest.mark.parametrize("kind", P.KINDS)
def test_no_python_in_the_plan(spark, kind):
    plan = P.with_pseudonyms(spark.createDataFrame([("x",)], "text string"), P.DEFAULT_KEY)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_all_phones_in_texts(spark):
    phones = ["+1 (017) 555-7713", "(171) 555-2028", "017-555-7713", "+14155552671", "+1 4155552671", "415-555-2671", "+44 (017) 5557713", "+490175557713"]
    kept = ["14155552671", "+141555526", "+141555526711234", "415 5552671"]
    df = spark.createDataFrame([(i, f"call {t}, now") for i, t in enumerate(phones + kept)], "doc_id long, text string")
    got = [r.text[5:-5] for r in P.with_pseudonyms(df, P.DEFAULT_KEY).orderBy("doc_id").collect()]
    assert got[len(phones) :] == kept
    new = dict(zip(phones, got))
    for old, p in new.items():
        assert p != old and re.sub(r"\d", "0", p) == re.sub(r"\d", "0", old)
        code, first = re.sub(r"\D", "", old)[:-10], re.sub(r"\D", "", p)[-10]
        assert re.sub(r"\D", "", p)[:-10] == code and (first < "2") == (re.sub(r"\D", "", old)[-10] < "2")
    ten = {old: re.sub(r"\D", "", p)[-10:] for old, p in new.items()}
    assert ten["+1 (017) 555-7713"] == ten["017-555-7713"] == ten["+44 (017) 5557713"] == ten["+490175557713"]
    assert ten["+14155552671"] == ten["+1 4155552671"] == ten["415-555-2671"]


def test_phones_are_permuted(spark):
    numbers = [f"({a}) 555-{b:04}" for a in ("017", "117", "217", "917") for b in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(numbers)], "doc_id long, text string")
    assert len({r.text for r in P.with_pseudonyms(df, P.DEFAULT_KEY).collect()}) == len(numbers)


def number_permutation(value, sizes, key, kind):
    (x, y), (m, n) = divmod(value, sizes[1]), sizes
    for r in range(1, P.ROUNDS + 1):
        x, y, m, n = y, (x + int(digest(key, kind, r, y)[:12], 16)) % m, n, m
    return x * sizes[1] + y


def social_security(text, key):
    area, group, serial = map(int, text.split("-"))
    v = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    v = number_permutation(v, (898 * 99, 9999), key, "ssn")
    place = v // (99 * 9999)
    return f"{place + 1 + (place >= 665):03d}-{v // 9999 % 99 + 1:02d}-{v % 9999 + 1:04d}"


def test_social_security_numbers_stay_valid(spark):
    rng = random.Random(8)
    texts = [f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(3000)]
    texts += ["583-67-9762", "001-01-0001", "899-99-9999", "665-01-0001", "667-99-9999"]
    texts = list(dict.fromkeys(texts))
    got = values(spark, texts)
    assert got == [social_security(t, P.DEFAULT_KEY) for t in texts]
    assert len(set(got)) == len(texts)
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", v) for v in got)
    assert values(spark, ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000"]) == [None] * 5


def test_the_key_comes_from_the_session(spark):
    assert P.session_key(spark) == P.DEFAULT_KEY
    spark.conf.set(P.KEY_SETTING, "another")
    try:
        assert P.session_key(spark) == "another"
    finally:
        spark.conf.unset(P.KEY_SETTING)
    df = spark.createDataFrame([(1, "call 212-555-0147")], "doc_id long, text string")
    assert P.with_pseudonyms(df, "another").first().text != P.with_pseudonyms(df, P.DEFAULT_KEY).first().text


def test_long_texts_and_repeated_rows(spark):
    text = "mail bob.smith@example.org or 212-555-0147 on 2001-02-03, " * 2000
    df = spark.createDataFrame([(1, text), (1, text), (2, "x" * 300_000)], "doc_id long, text string").selectExpr("*", "7 as found", "'y' as new", "3 as given")
    out = P.with_pseudonyms(df, P.DEFAULT_KEY).orderBy("doc_id").collect()
    assert out[0] == out[1] and out[2].text == "x" * 300_000 and (out[0].found, out[0].new, out[0].given) == (7, "y", 3)
    one = values(spark, ["bob.smith@example.org", "212-555-0147", "2001-02-03"])
    assert out[0].text == f"mail {one[0]} or {one[1]} on {one[2]}, " * 2000

import hashlib
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from strandline.llm import pseudonyms
from tests.llm.samples import SCHEMA, frame

KEY = "k"


def feistel(kind, left, right, size_l, size_r, key=KEY):
    for i in range(1, pseudonyms.ROUNDS + 1):
        h = int(hashlib.sha256(f"{key}|{kind}|{size_l}|{size_r}|{i}|{right}".encode()).hexdigest()[:15], 16)
        left, right = right, (left + h) % (size_l if i % 2 else size_r)
    return left, right


def permuted(kind, s, radix, block):
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"

    def text(v, n):
        out = ""
        for _ in range(n):
            out, v = digits[v % radix] + out, v // radix
        return out

    done = ""
    for a in range(0, len(s), block):
        part = s[a : a + block]
        half = len(part) // 2
        left, right = feistel(kind, int(part[:half] or "0", radix), int(part[half:], radix), radix**half, radix ** (len(part) - half))
        done += text(left, half) + text(right, len(part) - half)
    return done


def luhn(s):
    return sum((int(c) * (1 + k % 2) - 9 * (k % 2 and int(c) > 4)) for k, c in enumerate(reversed(s))) % 10


def swapped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonyms.pseudonymise(df, KEY).orderBy("doc_id").collect()]


def test_cards_against_a_plain_version(spark):
    cards = ["4111111111111111", "5555555555554444", "378282246310005", "6011111111111117"]
    out = swapped(spark, cards + ["4111 1111 1111 1111", "4111111111111112"])
    for before, after in zip(cards, out):
        body = before[0] + permuted("card", before[1:-1], 10, 36)
        assert after == next(body + d for d in "0123456789" if luhn(body + d) == 0)
        assert after != before and luhn(after) == 0
    assert out[4].replace(" ", "") == out[0] and re.fullmatch(r"\d{4}( \d{4}){3}", out[4])
    assert out[5] == "4111111111111112"  # does not validate


def test_dates_permute_days(spark):
    days = [date(1999, 12, 31) + timedelta(k) for k in range(0, 9000, 37)]
    out = swapped(spark, [d.isoformat() for d in days])
    for d, got in zip(days, out):
        n = (d - date(1800, 1, 1)).days
        left, right = feistel("date", n // 773, n % 773, 189, 773)
        assert got == (date(1800, 1, 1) + timedelta(left * 773 + right)).isoformat()
    assert len(set(out)) == len(days)
    a, b, c, bad = swapped(spark, ["on 31.12.1999.", "31/12/1999", "12/31/1999", "2000-02-30 2000-13-01"])
    iso = out[0]
    y, m, d = iso.split("-")
    assert (a, b, c, bad) == (f"on {d}.{m}.{y}.", f"{d}/{m}/{y}", f"{m}/{d}/{y}", "2000-02-30 2000-13-01")


def test_numbers_stay_valid_and_linked(spark):
    texts = ["call +1 (741) 555-3069 now", "+17415553069", "x 123-45-6789 y", "000-12-3456", "DE89 3704 0044 0532 0130 00", "GB28NWBK60161331926819", "at 43.21.141.162", "256.1.1.1"]
    out = swapped(spark, texts)
    phone = re.fullmatch(r"call (\+1 \(([2-9]\d\d)\) ([2-9]\d\d)-(\d{4})) now", out[0])
    assert phone and out[1] == "+1" + "".join(phone.groups()[1:]) and out[0] != texts[0]
    ssn = re.fullmatch(r"x (\d{3})-(\d\d)-(\d{4}) y", out[2])
    assert ssn and 1 <= int(ssn[1]) <= 899 and ssn[1] != "666" and ssn[2] != "00" and ssn[3] != "0000"
    iban = out[4].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != texts[4].replace(" ", "")
    left, right = feistel("ipv4", 43 * 256 + 21, 141 * 256 + 162, 65536, 65536)
    assert out[6] == f"at {left // 256}.{left % 256}.{right // 256}.{right % 256}"
    assert [out[k] for k in (3, 5, 7)] == [texts[k] for k in (3, 5, 7)]


def test_strings_are_permuted(spark):
    token = "ffc3105535f423f352535e4ac53b5fefe076ac6d"
    out = swapped(spark, [f'token = "{token}"', "mail Jo.smith+1@Example.org!", "é.42@mail9.example.com", token.upper()])
    assert out[0] == f'token = "{permuted("hex", token, 16, 28)}"' and out[3] == permuted("hex", token, 16, 28).upper()
    new = permuted("email", "josmith1", 36, 22)
    assert out[1] == f"mail {new[:2]}.{new[2:7]}+{new[7:]}@Example.org!" and out[2].startswith("é.") and "é.42" not in out[2]


@pytest.mark.parametrize("sizes", [(189, 773), (1, 10), (10, 100), (7, 3)])
def test_the_network_is_a_bijection(sizes):
    a, b = sizes
    assert len({feistel("t", k // b, k % b, a, b) for k in range(a * b)}) == a * b


def test_awkward_rows_keep_their_columns(spark):
    docs = frame(spark).withColumn("n_card", F.lit("clash"))
    out = pseudonyms.pseudonymise(docs, KEY)
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    counted = pseudonyms.pseudonymise_counted(docs, KEY)
    assert counted.agg(F.sum("n_values"), F.sum("n_card")).first() == (0, 0)
    assert pseudonyms.pseudonymise(spark.createDataFrame([], SCHEMA), KEY).count() == 0
    same = swapped(spark, ["a 4111111111111111 b 4111111111111111", "4111111111111111"])
    assert same[0] == f"a {same[1]} b {same[1]}"


def test_plan_is_native(spark, sf):
    plan = pseudonyms.pseudonymise(spark.read.parquet(f"{sf}/documents.parquet"), KEY)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "mail a.b@example.org", "x", "y", "z", "w")], "doc_id long, text string, found string, new string, kinds string, _kinds string")
    out = pseudonyms.pseudonymise(docs, "key")
    row = out.first()
    assert out.columns == docs.columns and (row.found, row.new, row.kinds, row["_kinds"]) == ("x", "y", "z", "w") and row.text != "mail a.b@example.org"
    assert pseudonyms.pseudonymise_counted(docs, "key").first().n_email == 1

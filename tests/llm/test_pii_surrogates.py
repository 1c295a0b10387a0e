from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from answerloom.llm import pii_surrogates as P


def replaced(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.text for r in sorted(P.replace_entities(docs, key=key).collect())]


def luhn(digits):
    total = 0
    for ix, d in enumerate(reversed([int(c) for c in digits if c.isdigit()])):
        total += d if ix % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10


def test_formats_and_coreference(spark):
    texts = [
        "Mr. John Smith met Mrs. Mary Jones. Smith called +1 (858) 555-7280.",
        "858-555-7280 is of John Smith, card 4547-3700-1758-0761 or 4547370017580761; JOE@X.EXAMPLE.COM joe@x.example.com",
        "Госпожа Анна Иванова, 10.1.2.3 and 123-45-6789, Version 2.0 of Apache License",
    ]
    a, b, c = replaced(spark, texts)
    given, surname = re.match(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+)\.", a).group(1, 2)
    assert given in P.GIVEN["latin", "m"] and surname != "Smith" and len(surname) == 5
    assert f"{surname} called +1 (" in a and f"of {given} {surname}," in b
    assert re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", a).groups() == re.match(r"(\d{3})-(\d{3})-(\d{4})", b).groups()
    cards = re.search(r"card (\d{4}-\d{4}-\d{4}-\d{4}) or (\d{16});", b).groups()
    assert cards[0].replace("-", "") == cards[1] and cards[1][0] == "4" and luhn(cards[1]) == luhn("4547370017580761")
    mails = b.rsplit(" ", 2)[1:]
    assert mails[0] == mails[1].upper() and mails[1].endswith(".com") and "joe" not in mails[1]
    assert re.match(r"Госпожа [А-Я][а-я]+ [А-Я][а-я]+, 10\.\d+\.\d+\.\d+ and \d{3}-\d{2}-\d{4}, Version 2\.0 of Apache License", c)
    assert not re.search("Анна|Иванова|John|Smith|Mary|Jones|555-7280|45473700|123-45-6789", a + b + c)


def test_names_written_in_other_ways(spark):
    """Possessives, inner capitals, double names, capitals and parts still mean the same person."""
    text = (
        "Dr. Smith's car. Mr. Smith left, SMITH said; Smith's and Smith-like. Mrs. Mary O'Brien, O'Brien's. "
        "Ms. McDonald or McDonald. Mr. Paul Smith-Jones, Smith-Jones, Jones. Goldsmith Smithers smith 1Smith"
    )
    found = replaced(spark, [text])[0]
    said = re.match(r"Dr\. (\w+)'s car\. Mr\. (\w+) left, (\w+) said; (\w+)'s and (\w+)-like\.", found).groups()
    assert said[0] == said[1] == said[3] == said[4] and said[2] == said[0].upper() and said[0] != "Smith"
    obrien = re.search(r"Mrs\. (\w+) ([\w']+), ([\w']+)'s\. ", found).groups()
    assert obrien[0] in P.GIVEN["latin", "f"] and obrien[1] == obrien[2] and "Brien" not in found
    assert re.search(r"Ms\. (\w+) or (\w+)\.", found)[1] == re.search(r"Ms\. (\w+) or (\w+)\.", found)[2] and "Donald" not in found
    double = re.search(r"Mr\. (\w+) ([\w-]+), ([\w-]+), Jones\. ", found).groups()
    assert double[1] == double[2] and "Smith-Jones" not in found
    assert found.endswith("Jones. Goldsmith Smithers smith 1Smith")


def test_later_mentions_by_given_name_alone(spark):
    """A given name alone means the person of the text; a word that is a surname too is taken as that."""
    a, b = replaced(spark, ["Mr. John Smith came. John sat down, JOHN's hat. Mrs. Xenia Paul and Paul Jones; Xenia, Paul.", "John stays."])
    said = re.match(r"Mr\. (\w+) (\w+) came\. (\w+) sat down, (\w+)'s hat\. Mrs\. (\w+) (\w+) and (\w+) (\w+); (\w+), (\w+)\.", a).groups()
    assert said[0] == said[2] and said[3] == said[0].upper() and said[0] != "John"
    assert said[4] == said[8] and said[5] == said[9] != said[6]
    assert not re.search("(?i)john|smith|xenia|paul|jones", a) and b == "John stays."


def test_given_surrogate_is_not_replaced_again(spark):
    """A listed given name may be a real surname of the same text; each keeps its own surrogate."""
    text = " ".join(f"Mr. Hans {name}, {name}." for name in P.GIVEN["latin", "m"] if name != "Hans")
    found = replaced(spark, [text])[0]
    pairs = re.findall(r"Mr\. (\w+) (\w+), (\w+)\.", found)
    assert len(pairs) == len(P.GIVEN["latin", "m"]) - 1
    assert len({given for given, _, _ in pairs}) == 1 and all(a == b for _, a, b in pairs)
    assert len({a for _, a, _ in pairs}) == len(pairs)


def test_surrogates_are_distinct_and_never_real(spark):
    """More one-letter mailboxes than there are letters to draw, and both halves of a small space of numbers."""
    mails = [f"{c}@x.co" for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    found = replaced(spark, mails)
    assert len(set(found)) == len(mails) and not set(found) & set(mails)
    assert replaced(spark, mails) == found and replaced(spark, mails, "other") != found


def test_whole_runs_of_names(spark):
    """No word of a name stays: inner names, initials, capitals, particles, two titles."""
    texts = {
        "Mary Ann Smith came.": r"(\w+) (\w+) (\w+) came\.",
        "Dr. John Paul Smith came.": r"Dr\. (\w+) (\w+) (\w+) came\.",
        "Mr. J. Smith came.": r"Mr\. (\w)\. (\w+) came\.",
        "John Q. Smith came.": r"(\w+) (\w)\. (\w+) came\.",
        "Michelle Jones came.": r"(\w+) (\w+) came\.",
        "MR. JOHN SMITH came.": r"MR\. ([A-Z]+) ([A-Z]+) came\.",
        "MARY JONES came.": r"([A-Z]+) ([A-Z]+) came\.",
        "Prof. Dr. Mary Smith came.": r"Prof\. Dr\. (\w+) (\w+) came\.",
        "Maria de la Cruz came.": r"(\w+) de la (\w+) came\.",
        "Herr Иван П. Петров пришёл.": r"Herr (\w+) (\w)\. (\w+) пришёл\.",
    }
    for (text, shape), found in zip(texts.items(), replaced(spark, list(texts)), strict=True):
        said = re.fullmatch(shape, found)
        assert said, (text, found)
        real = set(re.findall(r"[^\W\d_]+", text)) - {"Dr", "Prof", "Mr", "MR", "Herr", "de", "la", "came", "пришёл"}
        assert not real & set(said.groups()), (text, found)


def test_other_kinds(spark):
    texts = [
        "passport X12345678 here",
        "Account number: 123456789012, routing 021000021",
        "driver's license D1234567 and dl 7654321",
        "call 0171 1234567 or +49 171 1234567",
        "pay bc1qar3srrr7xfkvy5e643d2dnw9re59gtzz2f5md or 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa",
        "from 2001:db8:0:1:2:3:4:5 and fe80::1:2a",
        "id 987-65-4321",
    ]
    found = replaced(spark, texts)
    shapes = [
        r"passport ([A-Z]\d{8}) here",
        r"Account number: (\d{12}), routing (\d{9})",
        r"driver's license (D\d{7}) and dl (\d{7})",
        r"call (017\d \d{7}) or (\+49 1\d\d \d{7})",
        r"pay (bc1[0-9a-z]{38}) or (1\w{33})",
        r"from ([0-9a-f:]+) and (fe80::[0-9a-f]+:[0-9a-f]+)",
        r"id (9\d\d-\d\d-\d{4})",
    ]
    for text, said, shape in zip(texts, found, shapes, strict=True):
        real, made = re.fullmatch(shape, text), re.fullmatch(shape, said)
        assert real and made, (text, said)
        assert all(a != b for a, b in zip(real.groups(), made.groups(), strict=True)), (text, said)
    harmless = ["std::vector a::b 12:30:45 and 1.2.3", "Version 2.0, order 1234567 and X1234", "The Quick Brown Fox"]
    assert replaced(spark, harmless) == harmless


def test_every_private_address_in_one_step(spark):
    """A number space that is full: distinct, none its own, in the same network, without rounds."""
    octets = spark.range(65_536).select(F.concat(F.lit("192.168."), F.expr("id div 256"), F.lit("."), F.expr("id % 256")).alias("text"), F.col("id").alias("doc_id"))
    rows = P.replace_entities(octets, "k").join(octets.withColumnRenamed("text", "real"), "doc_id")
    told = rows.agg(
        F.count_distinct("text").alias("n"), F.sum((F.col("text") == F.col("real")).cast("int")).alias("same"), F.sum(F.col("text").rlike(r"^192\.168\.").cast("int")).alias("kept")
    ).first()
    assert (told.n, told.same, told.kept) == (65_536, 0, 65_536)


@pytest.mark.parametrize("a, b", [(2, 3), (1, 7), (7, 1), (10, 10), (16, 256), (255, 4)])
def test_permutations_without_a_fixed_point(spark, a, b):
    pairs = spark.range(a * b).select(F.expr(f"id div {b}").alias("l"), F.expr(f"id % {b}").alias("r"))
    made = pairs.select("l", "r", P._permuted("k", F.lit("t"), F.col("l"), F.col("r"), F.lit(a), F.lit(b)).alias("p")).collect()
    after = {(x.p.l, x.p.r) for x in made}
    assert after == {(x.l, x.r) for x in made} and all((x.l, x.r) != (x.p.l, x.p.r) for x in made)


def slow_pair(key, label, left, right, a, b):
    """The permutation written out in Python."""

    def prf(turn, value, size):
        return int(hashlib.sha256(f"{key}|{label}|{turn}|{value}".encode()).hexdigest()[:15], 16) % size

    for turn in range(4):
        left, right = ((left + prf(turn, right, a)) % a, right) if turn % 2 == 0 else (left, (right + prf(turn, left, b)) % b)
    place = (left * b + right + 1 + prf("shift", "", a * b - 1)) % (a * b)
    left, right = divmod(place, b)
    for turn in reversed(range(4)):
        left, right = ((left - prf(turn, right, a)) % a, right) if turn % 2 == 0 else (left, (right - prf(turn, left, b)) % b)
    return left, right


def test_numbers_equal_a_slow_version(spark):
    """Networks, areas and check sums by the rules, digits by the permutation written out."""
    draw = random.Random(4)
    numbers = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    ssns = [numbers(9) for _ in range(150)]
    cards = [numbers(16) for _ in range(150)]
    phones = [numbers(10) for _ in range(150)]
    ips = [".".join(str(draw.choice([0, 1, 10, 11, 16, 31, 32, 127, 128, 167, 168, 169, 172, 192, 193, 223, 224, 255, draw.randrange(256)])) for _ in range(4)) for _ in range(600)]
    texts = [f"{s[:3]}-{s[3:5]}-{s[5:]}" for s in ssns] + [f"no {c}." for c in cards] + [f"({p[:3]}) {p[3:6]}-{p[6:]}" for p in phones] + ips
    found = replaced(spark, texts)
    for text, said in zip(texts, found, strict=True):
        real, made = re.sub(r"\D", "", text), re.sub(r"\D", "", said)
        assert re.sub(r"\d+", "", text) == re.sub(r"\d+", "", said)
        if "." in text and text[0] != "n":
            old, new = [int(x) for x in text.split(".")], [int(x) for x in said.split(".")]
            net = lambda o: "x" if o[0] in (0, 127, 10) or o[0] > 223 else (o[0] == 192 and o[1] == 168, o[0] == 172 and 16 <= o[1] < 32)
            assert net(old) == net(new) and old != new and all(0 <= x < 256 for x in new), (text, said)
            if old[0] in (0, 10, 127, 172, 192) or old[0] > 223:
                assert old[0] == new[0]
        elif len(real) == 9:
            low = 900 if real[0] == "9" else 0
            left, right = slow_pair("k", f"ssn:{low}:0", int(real[:3]) - low, int(real[3:]), 100 if low else 900, 10**6)
            assert made == f"{left + low:03}{right:06}"
        elif len(real) == 16:
            left, right = slow_pair("k", f"card:{real[0]}:{luhn(real)}:14", int(real[1:8]), int(real[8:15]), 10**7, 10**7)
            assert made[:15] == f"{real[0]}{left:07}{right:07}" and luhn(made) == luhn(real)
        else:
            one, two = 200 * (real[0] >= "2"), 2_000_000 * (real[3] >= "2")
            left, right = slow_pair("k", f"phone:{one}:{two}", int(real[:3]) - one, int(real[3:]) - two, 800 if one else 200, 8_000_000 if two else 2_000_000)
            assert made == f"{left + one:03}{right + two:07}"


def test_texts_with_the_sign_of_the_cuts(spark):
    """Control characters of the text stay where they are."""
    a, b = replaced(spark, ["x\x01y joe@x.org \x01 z\x01", "x y joe@x.org  z"])
    mail = re.fullmatch("x\x01y (\\S+) \x01 z\x01", a)[1]
    assert b == f"x y {mail}  z" and mail != "joe@x.org"


def test_a_key_is_needed(spark, awkward):
    with pytest.raises(ValueError, match="key"):
        P.replace_entities(awkward, "")


def test_a_million_characters_do_not_hurt(spark):
    texts = ["Aa " * 100_000 + "x@y.zz", "a" * 1_000_000 + "@", "1" * 500_000, "1." * 200_000, "a.b-" * 100_000 + "@c"]
    found = replaced(spark, texts)
    assert "x@y.zz" not in found[0] and len(found[0]) == len(texts[0]) and found[1:4] == texts[1:4]


def test_awkward_rows(spark, awkward, nothing):
    rows = P.replace_entities(awkward, "k").collect()
    assert len(rows) == awkward.count() and {r.n_entities for r in rows} == {0}
    assert [r.text for r in rows if r.doc_id == 3] == [None]
    assert P.replace_entities(nothing, "k").collect() == []

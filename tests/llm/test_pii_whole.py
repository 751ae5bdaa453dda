"""Surrogates against a plain list of entities: distinct, coreferent, ending, linear."""

import random
import re
import time

import pytest

from ledgerlake.llm import pii

KEY = b"another key"
NAMES = ["Anna", "John", "Maria", "Peter", "Olga", "Smith", "Brown", "Müller", "Иванова", "Petrov"]


def planted(rnd):
    """(kind, canonical entity, written form) of one made-up entity."""
    kind = rnd.choice(["email", "phone", "card", "ip", "ssn"])
    n = lambda k, low=0: "".join(str(rnd.randrange(low if not i else 0, 10)) for i in range(k))
    if kind == "email":
        x = f"{rnd.choice('abcde')}{rnd.choice('xyz')}{n(1)}@m{n(1)}.example.com"
        return kind, x, rnd.choice([x, x.upper()])
    if kind == "phone":
        a, b, c = n(3, 2), n(3, 2), n(4)
        return kind, a + b + c, rnd.choice([f"+1 ({a}) {b}-{c}", f"+1 {a}-{b}-{c}", f"{a}-{b}-{c}", f"({a}) {b}-{c}"])
    if kind == "card":
        x = "4" + n(3) + n(4) + n(4) + n(3)
        x += str(pii.luhn(x))
        return kind, x, rnd.choice([x, "-".join(x[k : k + 4] for k in range(0, 16, 4))])
    if kind == "ip":
        x = rnd.choice([f"10.{n(1)}.{n(1)}.{n(1)}", f"192.168.0.{n(1)}", f"{rnd.randrange(20, 99)}.1.2.{n(1)}"])
        return kind, x, x
    return kind, (x := f"{rnd.randrange(100, 600)}1{rnd.randrange(1, 10)}{n(4, 1)}"), f"{x[:3]}-{x[3:5]}-{x[5:]}"


def plain_form(kind, text):
    if kind == "phone":
        return re.sub(r"\D", "", text)[-10:]
    return re.sub(r"\D", "", text) if kind in ("card", "ssn") else text.lower()


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_surrogates_are_a_one_to_one_function(spark, broadcast):
    rnd = random.Random(3)
    pool = [planted(rnd) for _ in range(250)]
    docs, listed = [], []
    for i in range(300):
        some = [rnd.choice(pool) for _ in range(rnd.randrange(4))]
        docs.append((i, "start " + " | ".join(w for *_, w in some) + " end"))
        listed.append(some)
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(spark.createDataFrame(docs, "doc_id long, text string"), KEY, broadcast_bytes=broadcast).collect()}
    made: dict = {}
    for (i, _), some in zip(docs, listed):
        shown = got[i].removeprefix("start ").removesuffix(" end").split(" | ") if some else []
        assert len(shown) == len(some)
        for (kind, canon, written), new in zip(some, shown):
            assert made.setdefault((kind, canon), plain_form(kind, new)) == plain_form(kind, new)
            assert kind == "ip" or re.sub(r"\d", "0", re.sub(r"[^\W\d_]", "a", written))[:3] == re.sub(r"\d", "0", re.sub(r"[^\W\d_]", "a", new))[:3]
            assert kind != "card" or int(plain_form(kind, new)[-1]) == pii.luhn(plain_form(kind, new)[:-1])
    by_kind = {k: [v for (kind, _), v in made.items() if kind == k] for k, *_ in pool}
    real = {(k, c) for k, c, _ in pool}
    for kind, forms in by_kind.items():
        assert len(set(forms)) == len(forms)
    assert not {(k, v) for (k, _), v in made.items() if k not in ("ip",)} & real


def test_a_full_space_of_numbers_ends(spark):
    docs = [(k, " and ".join(f"+358 {n:04d}" for n in range(500 * k, 500 * (k + 1)))) for k in range(20)]
    got = pii.replace_pii(spark.createDataFrame(docs, "doc_id long, text string"), KEY).collect()
    pairs = [(old, new) for r in got for old, new in zip(dict(docs)[r["doc_id"]].split(" and "), r["text"].split(" and "))]
    assert len({n for _, n in pairs}) == 10_000 and all(a != b and re.fullmatch(r"\+358 \d{4}", b) for a, b in pairs)


def test_full_spaces_of_short_addresses_and_names_end(spark):
    text = " ".join(f"{a}{b}@q.example.com" for a in "bcdfghjklmnpqrstvwxyz" for b in "aeiou")
    names = ". ".join(f"Mr {a.title()} {b.title()}" for a in pii.SYLLABLES["latin"] for b in ("bana", "dona"))
    got = pii.replace_pii(spark.createDataFrame([(1, text), (2, names)], "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    new = got[0]["text"].split()
    assert len(set(new)) == 105 and not set(new) & set(text.split())


def test_one_person_and_one_number_across_forms(spark):
    docs = [
        (1, "call +1 415-555-2671 or 415-555-2671 or (415) 555-2671"),
        (2, "Mr John Smith wrote."),
        (3, "Dr John Smith answered, and Prof. Maria Brown; Smith-Jones is not Smith. JOHN left"),
        (4, "Mrs Maria Brown. Dr Robin Brown"),
    ]
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(spark.createDataFrame(docs, "doc_id long, text string"), KEY).collect()}
    numbers = {plain_form("phone", x) for x in re.findall(r"[+(\d][-() \d]{10,}\d", got[1])}
    assert len(numbers) == 1 and numbers != {"4155552671"}
    john, smith = got[2].split()[1:3]
    assert got[3].startswith(f"Dr {john} {smith} answered") and got[3].split()[-2] == john.upper()
    maria, brown = got[4].rstrip().split(". ")[0].split()[1:3]
    assert f"Prof. {maria} {brown};" in got[3] and got[4].endswith(" " + brown)


def test_long_runs_take_linear_time():
    for text in ("@ " + "a" * 1_000_000, "a@b" + "c-" * 500_000, "Mr John Smith " + "Smith-" * 200_000, "1" * 1_000_000, "x@" * 300_000):
        began = time.monotonic()
        pii.find(text)
        assert time.monotonic() - began < 5
    many = " ".join(f"Mr A{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}n Bo." for k in range(10_000))
    began = time.monotonic()
    pii.find(many)
    assert time.monotonic() - began < 10


def test_emails_equal_a_plain_pattern():
    plain = re.compile(r"[^\W_](?:[\w.%+-]*[^\W_])?@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}")
    rnd = random.Random(8)
    for _ in range(3000):
        text = "".join(rnd.choice("ab1_.%-@@ é") for _ in range(rnd.randrange(40)))
        assert list(pii.emails(text)) == [m.span() for m in plain.finditer(text)], text


def test_pii_clashing_columns(spark):
    extra = ["_pii_again", "_PII_H", "_pii_h", "kind", "canon", "_pii_spans"]
    for limit in (1 << 20, 0):
        df = spark.createDataFrame([(1, "a1@b.example.com", *extra[1:2], "x", "y")], "doc_id long, text string, _pii_again string, kind string, _pii_spans string")
        r = pii.replace_pii(df, KEY, broadcast_bytes=limit).first()
        assert (r["_pii_again"], r["kind"]) == ("_PII_H", "x") and len(r["_pii_spans"]) == 1 and r["text"] != "a1@b.example.com"

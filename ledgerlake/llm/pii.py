"""Keyed, type-consistent surrogates for personal data.

Detected: e-mail addresses, phone numbers, card-like numbers of 13 to 19 digits,
IPv4 addresses, social security numbers, IBANs, and names after a title, with
later mentions of their parts in the same document.  Every entity gets a
surrogate of its own kind:

* numbers (IBANs too) go through a keyed permutation of their space (a shift
  between two halves of a Feistel net, with cycle walking inside the class of
  valid or invalid numbers): one-to-one by construction, and no number of a class
  of two or more stays itself.  Separators, country code, issuer digit, Luhn and
  other check digits and address range are kept;
* e-mail addresses keep length, letter classes, script, case and top level
  domain; one domain gets one surrogate;
* names keep gender (from the title), script and capitals, part by part, so that
  a full name and a later surname still refer to one person.

Surrogates depend on the key and the canonical form only, so one entity has one
surrogate in the whole corpus.  A phone number of the North American plan is one
entity with and without its country code.  A given name whose title tells no
gender is the one whose gender the document tells, or else the corpus, where it
knows just one.  Distinctness is checked over the corpus: if two entities of a
kind (names are one kind) share a surrogate, or a surrogate is itself an entity
of the corpus, all but the first are drawn again, round by round, until none
clash.  Redrawn addresses and names grow longer, so their space never runs out.
A space of numbers that is so full that ROUNDS rounds do not settle it goes back
to the plain permutation, which is distinct by itself; there a surrogate may be
the number of another entity, as in a full space it must.
The exceptions found so are broadcast while their measured size allows it and
joined to their documents beyond that.

Defined cases: null text stays null; empty text has no entities; overlapping
detections are settled by start, then length; entities of any number and texts of
any length are processed whole, in time linear in the text; equal rows get equal
results; an empty table gives an empty result.  All columns of the input are
kept, but for one called ``_pii_spans``, which is replaced; working columns take
names that the input does not have.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, discard, fresh_names, materialize, tidied

KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "given", "family")
CLOSED = ("phone", "card", "ip", "ssn", "iban")
ROUNDS = 8
DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}")
CARD = re.compile(r"(?<![\w+])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})(?!\w)")
PHONE = re.compile(
    r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\1\d{4})(?!\w)"
)
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = re.compile(rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?![\w]|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
DIGIT = re.compile(r"\d")
#: Titles by gender (m, f, n for unknown).
TITLES = {
    "Mr": "m", "Mr.": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr.": "m", "Don": "m", "господин": "m", "Господин": "m", "κύριος": "m",
    "Mrs": "f", "Mrs.": "f", "Ms": "f", "Ms.": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra.": "f", "Doña": "f", "госпожа": "f", "Госпожа": "f", "κυρία": "f",
    "Dr": "n", "Dr.": "n", "Prof.": "n", "Professor": "n",
}
PART = r"[^\W\d_a-zà-öø-ÿа-яёα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)*"
WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
PIECE = re.compile(r"[^-'’]+")
NAME = re.compile(rf"(?<!\w)({'|'.join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True))})\s+({PART})(?:\s+({PART}))?")
#: Syllables by script, and endings by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fi ga ge go ka ke ko la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе бо ва ве ви га го да де до за зе ка ки ко ла ле ли ло ма ме ми мо на не ни но па пе по ра ре ри ро са се си со та те ти то".split(),
    "greek": "βα βε βο γα γε γο δα δε δο κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε πο ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
}
ENDINGS = {
    "latin": {"m": "n r s d l".split(), "f": "a ia ina ella".split(), "n": "n a r e".split()},
    "cyrillic": {"m": "н р с л".split(), "f": "а ия ина".split(), "n": "н а".split()},
    "greek": {"m": "ς ος ας".split(), "f": "α η ια".split(), "n": "ς α".split()},
}
LETTERS = ("bcdfghjklmnpqrstvwxyz", "aeiou", "áàâãäåéèêëíìîïóòôõöúùûü", "çñßšžł", "бвгджзклмнпрстфхцчш", "аеиоуыэюя", "βγδζθκλμνξπρστφχψ", "αεηιου")


def stream(key: bytes, *parts: object) -> Iterator[int]:
    """Endless keyed bytes."""
    block = 0
    while True:
        yield from hashlib.blake2b("\x1f".join(map(str, (*parts, block))).encode(), key=key[:64]).digest()
        block += 1


def number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key[:64], digest_size=16).digest(), "big")


def permuted(key: bytes, kind: str, x: int, low: int, high: int, attempt: int) -> int:
    """A keyed permutation of 0 <= x < low * high, without fixed points if there are
    two numbers at least: an alternating Feistel net, a shift, and the net back."""
    tag = (kind, attempt, low, high)
    a, b = x % low, x // low
    for r in range(4):
        a = (a + number(key, *tag, 2 * r, b)) % low
        b = (b + number(key, *tag, 2 * r + 1, a)) % high
    n = low * high
    x = (b * low + a + 1 + number(key, *tag, "shift") % max(n - 1, 1)) % n
    a, b = x % low, x // low
    for r in reversed(range(4)):
        b = (b - number(key, *tag, 2 * r + 1, a)) % high
        a = (a - number(key, *tag, 2 * r, b)) % low
    return b * low + a


def permuted_digits(key: bytes, kind: str, digits: str, attempt: int, ok=lambda s: True) -> str:
    """Digits to digits, one-to-one among those that are ok, and among the others."""
    n = len(digits)
    low, high = 10 ** (n // 2), 10 ** (n - n // 2)
    x = digits
    while True:
        x = str(permuted(key, kind, int(x), low, high, attempt)).zfill(n)
        if ok(x) == ok(digits):
            return x


def poured(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(digits: str) -> int:
    """The check digit that belongs behind the digits."""
    total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def card(key: bytes, canon: str, attempt: int) -> str:
    body = canon[0] + permuted_digits(key, "card", canon[1:-1], attempt)
    return body + str((luhn(body) + int(canon[-1]) - luhn(canon[:-1])) % 10)


def nanp(code: str, rest: str) -> bool:
    return code == "1" and len(rest) == 10


def phone(key: bytes, canon: str, attempt: int) -> str:
    """canon: country code, a bar, the other digits."""
    code, rest = canon.split("|")
    return permuted_digits(key, "phone" + code, rest, attempt, (lambda s: s[0] > "1") if nanp(code, rest) else lambda s: True)


PRIVATE = ((24, 10), (20, 172 << 4 | 1), (16, 192 << 8 | 168))


def ip_class(x: int) -> int:
    return 2 if any(x >> n == head for n, head in PRIVATE) else int(0 < x >> 24 < 224)


def ip(key: bytes, canon: str, attempt: int) -> str:
    """Private addresses stay in their range, others among the public or the reserved."""
    a, b, c, d = map(int, canon.split("."))
    x = a << 24 | b << 16 | c << 8 | d
    bits = next((n for n, head in PRIVATE if x >> n == head), 32)
    y = x & (1 << bits) - 1
    while True:
        y = permuted(key, f"ip{bits}", y, 1 << bits // 2, 1 << bits - bits // 2, attempt)
        if bits < 32 or ip_class(y) == ip_class(x):
            break
    y |= x >> bits << bits
    return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))


def letters(key: bytes, kind: str, canon: str, attempt: int, seed: str) -> str:
    """Each letter to one of its class, each digit to a digit, the rest as it is."""
    random = stream(key, kind, attempt, seed)
    out = []
    for c in canon:
        if c.isdigit():
            out.append(str(next(random) % 10))
            continue
        of = next((s for s in LETTERS if c in s), None)
        if of:
            out.append(of[(next(random) << 8 | next(random)) % len(of)])
        elif c.isalpha():
            row = [chr(k) for k in range(ord(c) & ~15, (ord(c) | 15) + 1) if chr(k).isalpha() and chr(k).lower() == chr(k)] or [c]
            out.append(row[next(random) % len(row)])
        else:
            out.append(c)
    return "".join(out)


def email(key: bytes, canon: str, attempt: int) -> str:
    """Of the same length for WIDER attempts, then longer by a letter for each WIDER more."""
    local, _, domain = canon.partition("@")
    labels = domain.split(".")
    local += next((c for c in reversed(local) if c.isalpha()), "a") * (attempt // WIDER)
    return letters(key, "local", local, attempt, canon) + "@" + ".".join([letters(key, "domain", ".".join(labels[:-1]), 0, domain), labels[-1]])


WIDER = 4


def script_of(text: str) -> str:
    c = next((c for c in text if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ԯ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def name(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """canon: gender, a bar, the lower-cased part (gender only for given names)."""
    gender, _, part = canon.partition("|")
    script = script_of(part)
    random = stream(key, kind, attempt, canon)
    syllables = SYLLABLES[script]
    n = 2 + next(random) % 2 + (kind == "family") + attempt // WIDER
    ends = ENDINGS[script][gender if kind == "given" else "n"]
    stem, end = "".join(syllables[next(random) % len(syllables)] for _ in range(n)), ends[next(random) % len(ends)]
    return (stem[:-1] if end[0] in "aieоαηοιаи" else stem) + end


def iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def iban(key: bytes, canon: str, attempt: int) -> str:
    """Country stays, letters and digits keep their places, check digits are right."""
    country, body = canon[:2], canon[4:]
    sizes = [10 if c.isdigit() else 26 for c in body]
    half = len(body) // 2
    x = 0
    for c, n in zip(body, sizes):
        x = x * n + (int(c) if n == 10 else ord(c) - 65)
    shape = "".join("9" if n == 10 else "A" for n in sizes)
    x = permuted(key, "iban" + country + shape, x, math.prod(sizes[half:]), math.prod(sizes[:half]), attempt)
    out = []
    for n in reversed(sizes):
        x, k = divmod(x, n)
        out.append(str(k) if n == 10 else chr(65 + k))
    made = "".join(reversed(out))
    return country + iban_check(country, made) + made


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical surrogate of an entity."""
    if kind in ("given", "family"):
        return name(key, kind, canon, attempt)
    if kind == "ssn":
        return permuted_digits(key, "ssn", canon, attempt, lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000")
    return {"email": email, "phone": phone, "card": card, "ip": ip, "iban": iban}[kind](key, canon, attempt)


def form_of(kind: str, canon: str, made: str) -> str:
    """A surrogate in the form in which entities of its kind are compared."""
    return canon.split("|")[0] + "|" + made if kind == "phone" else made


def own_form(kind: str, canon: str) -> str:
    """An entity in that form."""
    return canon.partition("|")[2] if kind in ("given", "family") else canon


def space_of(kind: str, canon: str) -> str | None:
    """The space in which a number is permuted; None for kinds without bounds."""
    if kind == "phone":
        code, rest = canon.split("|")
        return f"{kind} {code} {len(rest)}"
    if kind == "ip":
        a, b, c, d = map(int, canon.split("."))
        x = a << 24 | b << 16 | c << 8 | d
        return f"{kind} {next((n for n, head in PRIVATE if x >> n == head), 32)}"
    if kind == "iban":
        return kind + canon[:2] + "".join("9" if c.isdigit() else "A" for c in canon[4:])
    return f"{kind} {len(canon)} {canon[0]}" if kind == "card" else kind if kind == "ssn" else None


def recased(shape: str, made: str) -> str:
    letters_ = [c for c in shape if c.isalpha()]
    if len(letters_) > 1 and all(c.isupper() for c in letters_):
        return made.upper()
    if letters_ and letters_[0].isupper() and all(c.islower() for c in letters_[1:]):
        return made[:1].upper() + made[1:]
    return "".join(m.upper() if k < len(shape) and shape[k].isupper() else m for k, m in enumerate(made))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so that a long run of letters is passed over once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and ((c := text[start - 1]).isalnum() or c in "_.%+-"):
            start -= 1
        while start < at and not text[start].isalnum():
            start += 1
        if start < at and text[at - 1].isalnum() and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def mentions(text: str, parts: dict[str, tuple[str, str]]) -> Iterator[tuple[int, int, str, str]]:
    """Where a known part of a name stands alone, in one pass over the words."""
    known = {**{p.upper(): e for p, e in parts.items()}, **parts}
    longest = max(len(PIECE.findall(p)) for p in parts)
    for m in WORD.finditer(text):
        if (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")) or text[m.end() : m.end() + 1].isalnum() or text[m.end() : m.end() + 1] == "_":
            continue
        run = m[0]
        if run in known:
            yield m.start(), m.end(), *known[run]
            continue
        pieces = [(x.start(), x.end()) for x in PIECE.finditer(run)]
        for i, (start, _) in enumerate(pieces):
            for _, end in pieces[i : i + longest]:
                if run[start:end] in known:
                    yield m.start() + start, m.start() + end, *known[run[start:end]]


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form), without overlaps, by start."""
    out: list[tuple[int, int, str, str]] = [(a, b, "email", text[a:b].lower()) for a, b in emails(text)]
    if DIGIT.search(text):
        digits = lambda s: "".join(c for c in s if c.isdigit())
        for m in CARD.finditer(text):
            out.append((m.start(), m.end(), "card", digits(m[0])))
        out += [(m.start(), m.end(), "ip", ".".join(str(int(x)) for x in m[0].split("."))) for m in IP.finditer(text)]
        rest = list(text)  # what is surely something else cannot be part of a phone number
        for start, end, *_ in out:
            rest[start:end] = "\0" * (end - start)
        for m in PHONE.finditer("".join(rest)):
            d = digits(m[0])
            if 7 <= len(d) <= 15:
                code = digits(re.split(r"[ .(-]", m[0], maxsplit=1)[0]) if m[0][0] == "+" else ""
                if m[0][0] == "+" and len(code) > 3:
                    code = code[:1] if code[0] in "17" else code[:2]
                rest_ = d[len(code) :]
                if not code and len(rest_) == 10 and rest_[0] > "1":
                    code = "1"
                out.append((m.start(), m.end(), "phone", code + "|" + rest_))
        out += [(m.start(), m.end(), "ssn", digits(m[0])) for m in SSN.finditer(text)]
        for m in IBAN.finditer(text):
            c = m[0].replace(" ", "")
            if 15 <= len(c) <= 34 and c[2:4] == iban_check(c[:2], c[4:]):
                out.append((m.start(), m.end(), "iban", c))
    if any(t in text for t in TITLES):
        named = []
        genders: dict[str, set[str]] = {}
        for m in NAME.finditer(text):
            if m[3]:
                named += [(m.start(2), m[2], "given", TITLES[m[1]]), (m.start(3), m[3], "family", "")]
                genders.setdefault(m[2].lower(), set()).add(TITLES[m[1]])
            else:
                named.append((m.start(2), m[2], "family", ""))
        parts: dict[str, tuple[str, str]] = {}
        for at, part, kind, gender in named:
            told = genders.get(part.lower(), set()) - {"n"}
            if gender == "n" and len(told) == 1:
                gender = min(told)
            canon = f"{gender}|{part.lower()}"
            parts.setdefault(part, (kind, canon))
            out.append((at, at + len(part), kind, canon))
        if parts:
            out += mentions(text, parts)
    kept: list[tuple[int, int, str, str]] = []
    for e in sorted(set(out), key=lambda e: (e[0], -e[1], KINDS.index(e[2]), e[3])):
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return kept


def written(kind: str, shape: str, canon: str, made: str) -> str:
    """A canonical surrogate in the written form of the entity it replaces."""
    if kind in ("email", "given", "family"):
        return recased(shape, made)
    if kind == "phone":
        code = canon.split("|")[0]
        return poured(shape, made if sum(c.isdigit() for c in shape) == len(made) else code + made)
    if kind == "iban":
        it = iter(made)
        return "".join(" " if c == " " else next(it) for c in shape)
    return made if kind == "ip" else poured(shape, made)


def replaced(
    text: str, key: bytes, attempts: dict[tuple[str, str], tuple[str, int]], memory: dict
) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and (start, end, kind) of them in the new text."""
    out, spans, at, length = [], [], 0, 0
    for start, end, kind, canon in find(text):
        made = memory.get((kind, canon))
        if made is None:
            if len(memory) > 200_000:
                memory.clear()
            made = memory[kind, canon] = surrogate(key, kind, *attempts.get((kind, canon), (canon, 0)))
        new = written(kind, text[start:end], canon, made)
        out += [text[at:start], new]
        length += start - at
        spans.append((length, length + len(new), kind))
        length += len(new)
        at = end
    return "".join([*out, text[at:]]), spans


KNOWN = "kind string, canon string, form string, own string, space string"


def entities(docs: DataFrame, key: bytes, text: str) -> DataFrame:
    """Distinct entities of the corpus: kind, canonical form, the forms in which its
    surrogate and itself are compared, and its space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {e[2:] for t in batch.column(0).to_pylist() if t for e in find(t)}
            rows = [(k, c, form_of(k, c, surrogate(key, k, c)), own_form(k, c), space_of(k, c)) for k, c in seen]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], ["kind", "canon", "form", "own", "space"])

    return docs.select(text).mapInArrow(tidied(run), KNOWN).distinct()


def known_persons(known: DataFrame) -> DataFrame:
    """(canon, target) of the given names without a gender that the corpus knows
    with just one gender."""
    given = known.filter("kind = 'given'").select("canon", "own", F.substring("canon", 1, 1).alias("gender"))
    told = given.filter("gender != 'n'").groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.min("canon").alias("target")).filter("n = 1")
    return given.filter("gender = 'n'").join(told, "own").select("canon", "target")


def clash_attempts(docs: DataFrame, key: bytes, text: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canon, target, attempt) of the entities whose surrogate is not the
    first one of their own canonical form."""
    found = materialize(entities(docs, key, text).withColumn("attempt", F.lit(0)), "pii-entities")
    persons = materialize(known_persons(found).withColumn("kind", F.lit("given")), "pii-persons")
    known = materialize(found.join(persons, ["kind", "canon"], "left_anti"), "pii-entities")
    discard(found)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, canons, attempts = (batch.column(i).to_pylist() for i in range(3))
            forms = [form_of(k, c, surrogate(key, k, c, a)) for k, c, a in zip(kinds, canons, attempts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms, pa.string()), *batch.columns[3:], batch.column(2)], ["kind", "canon", "form", "own", "space", "attempt"])

    family = F.when(F.col("kind").isin("given", "family"), F.lit("name")).otherwise(F.col("kind"))
    full = None
    n = 0
    while True:
        n += 1
        open_ = known.withColumn("class", family)
        if full is not None:
            open_ = open_.join(full, "space", "left_anti")
        shared = open_.groupBy("class", "form").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "kind", "canon")).alias("first")).filter("n > 1")
        twice = open_.join(shared, ["class", "form"]).filter((F.col("canon") != F.col("first.canon")) | (F.col("kind") != F.col("first.kind")))
        real = open_.select("class", F.col("own").alias("form")).distinct()
        taken = open_.join(real, ["class", "form"], "left_semi")
        clashing = materialize(twice.select("kind", "canon", "space").union(taken.select("kind", "canon", "space")).distinct(), "pii-clashing")
        if clashing.isEmpty():
            break
        if n > rounds:  # spaces of numbers that are too full: the plain permutation, distinct by itself
            spaces = clashing.filter("space IS NOT NULL").select("space")
            full = materialize((spaces if full is None else spaces.union(full)).distinct(), "pii-full")
            clashing = clashing.filter("space IS NULL")
        redo = known.join(clashing, ["kind", "canon"], "left_semi").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"), "own", "space")
        redo = redo.mapInArrow(again, KNOWN + ", attempt int")
        old, known = known, materialize(known.join(clashing, ["kind", "canon"], "left_anti").unionByName(redo), "pii-entities")
        discard(old)
    drawn = known.filter("attempt > 0")
    if full is not None:
        drawn = drawn.join(full, "space", "left_anti")
    drawn = drawn.select("kind", "canon", F.col("canon").alias("target"), "attempt")
    named = persons.join(drawn.filter("kind = 'given'").select("target", "attempt"), "target", "left")
    return drawn.union(named.select("kind", "canon", "target", F.coalesce("attempt", F.lit(0))))


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
AGAIN = "array<struct<kind:string,canon:string,target:string,attempt:int>>"


def replace_pii(docs: DataFrame, key: bytes, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents, all their columns, with surrogates in the text, and
    ``_pii_spans``, the places and kinds of the surrogates."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "_pii_spans"])
    again = materialize(clash_attempts(docs, key, text_col), "pii-attempts")
    small = again.count() * 240 <= broadcast_bytes
    if small:
        fixed = {(r["kind"], r["canon"]): (r["target"], r["attempt"]) for r in again.collect()}
        sent = docs.sparkSession.sparkContext.broadcast(fixed)
        src = docs.withColumn(fresh_names(docs, "_pii_again")[0], F.lit(None).cast(AGAIN))
    else:
        sent = None
        src = with_own_attempts(docs, again, text_col)
    at, last = docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField("_pii_spans", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
        for batch in batches:
            texts, spans = [], []
            for t, own in zip(batch.column(at), batch.column(last)):
                t, own = t.as_py(), own.as_py()
                if own:
                    attempts, memory = {(x["kind"], x["canon"]): (x["target"], x["attempt"]) for x in own}, {}
                else:
                    attempts = sent.value if sent else {}
                new, found = replaced(t, key, attempts, memory) if t else (t, [])
                if own:
                    memory = {}
                texts.append(new)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
            columns = batch.columns[:last]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(span))], [*batch.schema.names[:last], "_pii_spans"])

    return src.mapInArrow(tidied(run), schema)


def with_own_attempts(docs: DataFrame, again: DataFrame, text: str) -> DataFrame:
    """Documents with the redrawn entities they hold: by joins, for any number."""
    hash_col, own_col = fresh_names(docs, "_pii_h", "_pii_again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *e) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for e in {x[2:] for x in find(t or "")}]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2))], [hash_col, "kind", "canon"]
            )

    hashed = docs.select(F.xxhash64(text).alias(hash_col), F.col(text))
    own = hashed.mapInArrow(tidied(run), f"`{hash_col}` long, kind string, canon string").distinct().join(again, ["kind", "canon"])
    own = own.groupBy(hash_col).agg(F.collect_list(F.struct("kind", "canon", "target", "attempt")).alias(own_col))
    return docs.join(own, F.xxhash64(docs[text]) == own[hash_col], "left").select(*[docs[c] for c in docs.columns], own_col)

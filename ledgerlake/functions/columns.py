"""Column functions over narrations, money and dates; all stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t


def first_rule(text: Column, rules, default: Column | str, direction: Column | None = None) -> Column:
    """The label of the first rule whose pattern occurs; a pair of labels is
    for credits and debits."""
    occurs = lambda p: reduce(lambda x, w: x | text.contains(w), own_words(p)[1:], text.contains(own_words(p)[0])) & text.rlike(p) if own_words(p) else text.rlike(p)
    out = default if isinstance(default, Column) else F.lit(default)
    for label, pattern in reversed(rules):
        value = F.when(direction == "Credit", label[0]).otherwise(label[1]) if isinstance(label, tuple) else F.lit(label)
        out = F.when(occurs(pattern), value).otherwise(out)
    return out


def direction(debit: Column, credit: Column) -> Column:
    return F.when(F.coalesce(credit, F.lit(0)) >= F.coalesce(debit, F.lit(0)), "Credit").otherwise("Debit")


def mode(narration: Column, upper: Column | None = None) -> Column:
    return first_rule(F.upper(narration) if upper is None else upper, t.MODE_RULES, "OTHER")


def upper_text(*parts: Column) -> Column:
    """What the rules of fine_mode, party_category and counter_ledger read; as a column of its own it is made
    once a row, not once a word that is looked for."""
    return F.upper(F.concat_ws(" ", *parts))


def fine_mode(first_mode: Column, narration: Column, text: Column | None = None) -> Column:
    return first_rule(upper_text(first_mode, narration) if text is None else text, t.FINE_MODE_RULES, "TRANSFER")


def category(narration: Column, way: Column, upper: Column | None = None) -> Column:
    rest = F.when(way == "Credit", "Trade Credit").otherwise("Trade Debit")
    return first_rule(F.upper(narration) if upper is None else upper, t.CATEGORY_RULES, rest, way)


def party_text(party: Column, cat: Column, narration: Column) -> Column:
    return upper_text(party, F.coalesce(cat, F.lit("")), F.coalesce(narration, F.lit("")))


def party_category(party: Column, cat: Column, narration: Column, text: Column | None = None) -> Column:
    return first_rule(party_text(party, cat, narration) if text is None else text, t.PARTY_CATEGORY_RULES, F.coalesce(F.nullif(F.upper(cat), F.lit("")), F.lit("OTHER")))


def party_type(name: Column, confidence: Column) -> Column:
    n = F.upper(F.trim(name))
    merchants = [label for label, _ in t.RAILS + t.MERCHANTS]
    return (
        F.when(n.isNull() | n.isin("", "UNRECOGNIZED") | (confidence < 20), "unrecognized")
        .when(n.isin(*t.GENERIC_PARTIES, t.SELF_LABEL), "self")
        .when(n.isin(*t.CHARGE_LABELS), "charge")
        .when(n.isin(*t.BANK_SYSTEM_LABELS), "bank_system")
        .when(n.isin(*merchants) | n.rlike(t.BUSINESS_WORDS), "merchant")
        .otherwise("person")
    )


def counter_ledger(second_mode: Column, party_cat: Column, narration: Column, text: Column | None = None) -> Column:
    return first_rule(upper_text(second_mode, party_cat, narration) if text is None else text, t.COUNTER_LEDGER_RULES, "Others")


def voucher_type(way: Column, second_mode: Column) -> Column:
    return F.when(second_mode == "CASH", "Contra").when(way == "Credit", "Receipt").otherwise("Payment")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, " ", " "), r"\s+", " "))


def without_first(text: Column, pattern: str, put: str) -> Column:
    """The text with the first occurrence of a pattern replaced, as engines do
    whose replace is not global."""
    return F.regexp_replace(text, rf"(?is)^(.*?)(?:{pattern})", "$1" + put)


def own_word(pattern: str) -> str:
    """Letters or figures that every match of a pattern holds; empty where its start does not tell."""
    m = re.match(r"(?:\\b|\\\*\?|\\s\*)*([A-Z0-9]+)(?![?*{|])", pattern)
    return m[1] if m and not re.search(r"\|", pattern) else ""


def own_words(pattern: str) -> list[str]:
    """Words of which every match of a pattern holds one: a search for them is cheaper than the
    pattern, which is tried only where one occurs.  Empty where the pattern does not tell."""
    if listed := re.fullmatch(r"\\b\(([A-Z0-9 |]+)\)\\b", pattern):
        return [w for w in listed[1].split("|") if w] if "||" not in f"|{listed[1]}|" else []
    if re.search(r"\(|\[[^\]]*\|", pattern):
        return []
    words = [own_word(p) for p in pattern.split("|")]
    return words if all(words) else []


def without_each(text: Column, patterns: list[str], put: str) -> Column:
    """The first occurrence of each pattern replaced, one pattern after the other; a pattern
    is tried only where its word occurs."""
    tried = F.array(*[F.struct(F.lit(own_word(p)).alias("word"), F.lit(rf"(?is)^(.*?)(?:{p})").alias("pattern")) for p in patterns])
    return F.aggregate(tried, text, lambda x, p: F.when(F.contains(F.upper(x), p["word"]), F.regexp_replace(x, p["pattern"], F.lit("$1" + put))).otherwise(x))


def clean_narration(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(squeeze(text), r"\|+", " "))
    return squeeze(without_each(flat, t.HEADINGS, ""))


def without_boilerplate(text: Column) -> Column:
    return squeeze(without_each(text, [p.replace(".*", "[^\\n]*") for p in t.PHRASES], " "))


def is_footer(text: Column) -> Column:
    return F.upper(text).rlike(t.FOOTER)


def reads_like_sentence(text: Column) -> Column:
    words = F.filter(F.split(F.upper(text), r"\s+"), lambda w: w != "")
    filler = F.filter(words, lambda w: w.isin(*t.FILLER_WORDS))
    return (F.size(words) >= 3) & (F.size(filler) / F.size(words) >= 0.4)


def is_reference_code(token: Column) -> Column:
    u = F.upper(token)
    return reduce(lambda x, p: x | u.rlike(p), t.REFERENCE_SHAPES, F.lit(False))


def is_party_word(token: Column) -> Column:
    u = F.upper(token)
    return (
        u.rlike(r"[A-Z0-9]")
        & ~u.isin(*t.CHANNEL_WORDS, *t.PROCESS_WORDS)
        & ~is_reference_code(u)
        & ~u.rlike(t.MASKED_NUMBER)
        & (F.length(token) >= 3)
    )


def party_words(text: Column) -> Column:
    """The words of a text that may name a party."""
    trimmed = F.transform(F.split(F.upper(text), r"[^A-Z0-9.&]+"), lambda w: F.regexp_replace(w, r"^[.,;:]+|[.,;:]+$", ""))
    return F.filter(F.transform(trimmed, lambda w: F.regexp_replace(w, r"^([A-Z]{4,})\d{1,4}$", "$1")), is_party_word)


def once(value: Column, use) -> Column:
    """use(value) with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bank_event(narration: Column) -> Column:
    """struct(label, confidence) of a known event, own transfer or merchant, or null."""
    none = F.lit(None).cast("string")
    merchants = t.MERCHANTS
    some = "|".join(f"(?:{p})" for _, p in merchants)
    pair = lambda label, n: F.struct(label.alias("label"), F.lit(n).alias("confidence"))

    def of(text: Column) -> Column:
        event = first_rule(text, t.BANK_EVENTS, none)
        short = F.length(text) < 120
        return (
            F.when(short & text.rlike("|".join(f"(?:{p})" for _, p in t.BANK_EVENTS)), pair(event, 85))
            .when(short & text.rlike(t.SELF_TRANSFER), pair(F.lit(t.SELF_LABEL), 80))
            .when(text.rlike(some), pair(first_rule(text, merchants, none), 95))
        )

    known = once(F.upper(without_boilerplate(F.translate(narration, "_", " "))), of)
    return F.when(narration.isNotNull() & ~is_footer(narration), known)


def bank_of_code(text: Column) -> Column:
    u = F.upper(text)
    hits = [F.when(u.rlike(rf"\b{code}\b"), bank) for code, bank in t.BANK_CODES.items()]
    return F.coalesce(*hits, F.when(u.rlike(r"\bBARB0[A-Z0-9]+\b"), "BANK OF BARODA"))


# --- money -----------------------------------------------------------------


def money(x: Column) -> Column:
    """Absolute value of a finite number, else 0."""
    d = x.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(F.abs(d))


def round2(x: Column) -> Column:
    """Half up towards plus infinity at two decimals."""
    return F.floor((x.cast("double") + F.lit(2.220446049250313e-16)) * 100 + 0.5) / F.lit(100.0)


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x made once.  What f takes stays out of the generated method, which the JVM compiles only while it is short."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def amount_of_text(raw: Column) -> Column:
    """'1,23,456.00', '-5.00', '12.00 Dr' to a decimal; debits are negative.  A text without the
    letter r has no mark, and meets no regular expression."""

    def read(s: Column) -> Column:
        plain = F.replace(s, F.lit(","), F.lit(""))
        marked = s.contains("r") | s.contains("R")
        digits = F.when(marked, F.regexp_replace(plain, r"(?i)\s*(cr|dr)\.?\s*$", "")).otherwise(F.rtrim(plain))
        signed = lambda v: F.when(marked & s.rlike(r"(?i)dr\.?\s*$"), -F.abs(v)).otherwise(v)
        return bound(digits.try_cast("decimal(18,2)"), signed)

    return bound(raw, read)


def inr(x: Column) -> Column:
    """Lakh and crore display of an amount, in rupees."""
    v = F.abs(x.cast("double"))
    two = lambda y: F.format_string("%.2f", F.floor(y * 100 + 0.5) / 100)
    shown = F.when(v >= 1e7, F.concat(two(v / 1e7), F.lit(" Cr"))).when(v >= 1e5, F.concat(two(v / 1e5), F.lit(" L"))).otherwise(indian_grouped(F.floor(v + 0.5)))
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit("Rs "), shown)


def indian_grouped(x: Column) -> Column:
    """The whole part with a comma after the thousands and each two digits more."""
    whole = F.floor(F.abs(x.cast("double"))).cast("long").cast("string")
    tail = F.right(whole, F.lit(3))
    head = F.when(F.length(whole) > 3, F.left(whole, F.length(whole) - 3)).otherwise(F.lit(""))
    grouped = F.regexp_replace(head, r"(\d)(?=(\d\d)+$)", "$1,")
    sign = F.when(x < 0, "-").otherwise("")
    return F.concat(sign, F.when(head != "", F.concat(grouped, F.lit(","), tail)).otherwise(whole))


def axis_tick(x: Column) -> Column:
    v = F.abs(x.cast("double"))
    return (
        F.when(v >= 1e7, F.format_string("%.1fCr", x / 1e7))
        .when(v >= 1e5, F.format_string("%.1fL", x / 1e5))
        .when(v >= 1e3, F.format_string("%.0fK", x / 1e3))
        .otherwise(F.format_string("%.0f", x.cast("double")))
    )


# --- dates -----------------------------------------------------------------


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_label(d: Column) -> Column:
    return F.date_format(d, "MMM-yy")


def display_date(text: Column) -> Column:
    """Day, month name and year; what is no date stays as it is, nothing is a dash."""
    given = F.nullif(text.cast("string"), F.lit(""))
    return F.coalesce(F.date_format(parsed_date(given), "dd-MMM-yyyy"), given, F.lit("-"))


def date_tokens(text: Column) -> Column:
    """How many date-like tokens a text holds, as a sign that a page is upright."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b"), F.lit(0)))


def two_digit_year(y: Column, pivot: int) -> Column:
    n = y.cast("int")
    return F.when(F.length(y) == 4, n).when(n <= pivot, n + 2000).otherwise(n + 1900)


def parsed_date(text: Column, pivot: int = 69) -> Column:
    """ISO first, then day first with numeric or named months; an impossible day
    rolls over into the next month.  Each form is tested once and then cut by its marks."""
    num, named = r"^'?(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})\b", r"(?i)^'?(\d{1,2})[ -]([a-z]{3})[a-z]*[ -](\d{4}|\d{2})\b"
    built = lambda y, m, d: F.date_add(F.make_date(y, F.when(m.between(1, 12), m), F.lit(1)), d.cast("int") - 1)

    def numeric(p: Column) -> Column:
        year = F.when(F.substring(p[2], 3, 1).between("0", "9"), F.left(p[2], F.lit(4))).otherwise(F.left(p[2], F.lit(2)))
        return built(two_digit_year(year, pivot), p[1].cast("int"), p[0])

    def read(s: Column) -> Column:
        iso = F.to_date(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(s, F.lit(10))), "yyyy-MM-dd")
        by = lambda k: F.nullif(F.regexp_extract(s, named, k), F.lit(""))
        month_no = F.array_position(F.array(*[F.lit(m) for m in t.MONTHS]), F.upper(by(2))).cast("int")
        cut = F.split(F.translate(F.ltrim(s, F.lit("'")), "./", "--"), "-")
        return F.coalesce(
            iso, F.when(s.rlike(num), bound(cut, numeric)), F.when(s.rlike(named), built(two_digit_year(by(3), pivot), month_no, by(1)))
        )

    return bound(F.trim(text), read)


def key_of_label(label: Column, pivot: int = 50) -> Column:
    """'Jan-24' or '2024-01' to '2024-01'."""
    m = F.array_position(F.array(*[F.lit(x) for x in t.MONTHS]), F.upper(F.regexp_extract(label, r"^([A-Za-z]{3})[- ](\d{2,4})$", 1))).cast("int")
    y = two_digit_year(F.nullif(F.regexp_extract(label, r"^([A-Za-z]{3})[- ](\d{2,4})$", 2), F.lit("")), pivot)
    return F.when(label.rlike(r"^\d{4}-\d{2}$"), label).when(m > 0, F.format_string("%04d-%02d", y, m))


# --- similarity of names ---------------------------------------------------


def words(name: Column) -> Column:
    return F.filter(F.split(name, r"\s+"), lambda w: w != "")


def words_match(a: Column, b: Column) -> Column:
    """Equal, or of five letters and more with an edit distance of at most 16 %."""
    longer = F.greatest(F.length(a), F.length(b))
    near = (F.length(a) >= 5) & (F.length(b) >= 5) & (1 - F.levenshtein(a, b) / longer >= 0.84)
    return (a == b) | near


def word_overlap(a: Column, b: Column) -> Column:
    """Part of the words of a that match one of b, of the larger set."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    hits = F.size(F.filter(x, lambda w: F.exists(y, lambda v: words_match(w, v))))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(hits / F.greatest(F.size(x), F.size(y)))


def is_single_word_alias(a: Column, b: Column) -> Column:
    x, y = words(a), words(b)
    return (F.size(x) == 1) & (F.size(y) >= 2) & (F.length(F.get(x, F.lit(0))) >= 5) & F.array_contains(y, F.get(x, F.lit(0)))


def is_close_affix(a: Column, b: Column) -> Column:
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (
        (F.length(short) >= 3)
        & (F.length(short) < F.length(long))
        & (F.length(short) / F.length(long) >= 0.5)
        & (long.startswith(short) | long.endswith(short))
    )

"""PII surrogates and wrapper induction."""

import html
import itertools
import re

import pytest

from ledgerlake.llm import html_main, pii, queries

KEY = b"test key"
TEXTS = [
    "mail hein.19@mail5.example.com### and HEIN.19@MAIL5.EXAMPLE.COM, éa.1@x.example.org",
    "call +1 (523) 555-1055 or +49 30 1234567, 415-555-2671",
    "4785380592391139$$$ 4465758382889437 4465758382889437 4111-1111-1111-1111",
    "ip 233.233.171.252, 10.0.0.7 192.168.1.4 v1.2.3.4.5",
    "ssn 123-45-6789 DE89370400440532013000 GB29 NWBK 6016 1331 9268 19",
    "Mr. John Smith met Frau Anna Müller. Smith said hi to MÜLLER; госпожа Анна Иванова",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 2024-01-02 12345 1,000,000.00',
    None,
    "",
    "hein.19@mail5.example.com again",
]


def test_surrogates_replace_and_keep_the_rest(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in pii.replace_pii(df, KEY).collect()}
    assert got[6]["text"] == TEXTS[6] and got[7]["text"] is None and got[8]["text"] == ""
    for i, t in enumerate(TEXTS):
        for start, end, _, _ in pii.find(t or ""):
            assert t[start:end] not in got[i]["text"]
        shape = [(s["start"], s["end"]) for s in got[i]["_pii_spans"]]
        old = [(a, b) for a, b, *_ in pii.find(t or "")]
        outside = lambda x, spans: re.sub("", "", "".join(x[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(x)])))
        assert outside(t or "", old) == outside(got[i]["text"] or "", shape)
    first = got[0]["text"].split()
    assert first[1].removesuffix("###").upper() == first[3].rstrip(",")  # one entity, one surrogate, own capitals
    assert first[1].removesuffix("###") == got[9]["text"].split()[0]
    assert got[2]["text"].split()[1] == got[2]["text"].split()[2]
    a, b = got[5]["text"], got[0]
    assert a.startswith("Mr. ") and "Frau" in a and re.search("[А-я]{4,} [А-я]{4,}$", a) and b


def test_forms_are_kept():
    made, _ = pii.replaced("4111-1111-1111-1111", KEY, {}, {})
    digits = made.replace("-", "")
    assert re.fullmatch(r"4\d{3}-\d{4}-\d{4}-\d{4}", made) and pii.luhn(digits[:-1]) == int(digits[-1])
    assert pii.ip(KEY, "10.1.2.3", 0).startswith("10.") and pii.ip(KEY, "192.168.0.9", 0).startswith("192.168.")
    made, _ = pii.replaced("+1 (523) 555-1055", KEY, {}, {})
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) \d{3}-\d{4}", made)
    made, _ = pii.replaced("GB29 NWBK 6016 1331 9268 19", KEY, {}, {})
    c = made.replace(" ", "")
    assert int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_digit_permutation_is_one_to_one(n):
    made = {pii.permuted_digits(KEY, "x", str(i).zfill(n), 0) for i in range(10**n)}
    assert len(made) == 10**n
    assert pii.permuted_digits(KEY, "x", "12345678", 0) != pii.permuted_digits(KEY, "x", "12345678", 1)
    assert pii.permuted_digits(KEY, "x", "12345678", 0) != pii.permuted_digits(b"other", "x", "12345678", 0)


def test_clashes_are_drawn_again(spark, monkeypatch):
    names = ["".join(p) for p in itertools.product("abcdefgh", repeat=2)]
    texts = [f"{a}@q.example.com" for a in names]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    again = pii.clash_attempts(df, KEY, "text").collect()
    assert again  # 64 names of two letters must clash somewhere in a space this small
    for limit in (1 << 20, 0):
        got = [r["text"] for r in pii.replace_pii(df, KEY, broadcast_bytes=limit).orderBy("doc_id").collect()]
        assert len(set(got)) == len(texts) and not set(got) & set(texts)


def test_neighbours_do_not_hide_each_other():
    text = "+1 (826) 555-4081 190.137.223.204 +49 30 1234567 10.0.0.7 +1 (555) 555-1234 4465758382889437 a.1@b.example.com +1 212 555 0100"
    assert [k for *_, k, _ in pii.find(text)] == ["phone", "ip", "phone", "ip", "phone", "card", "email", "phone"]


def test_pii_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a@b.example.com", "x")], "doc_id long, text string, kind string")
    assert pii.replace_pii(df.limit(0), KEY).count() == 0
    r = pii.replace_pii(df, KEY).first()
    assert r["kind"] == "x" and len(r["_pii_spans"]) == 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a>Menu {0}</a></li></ul></nav><!-- x --><div class="ad banner">Buy {0}</div>
<div class="cookie-notice">We use cookies</div>{1}<aside>side {0}</aside><form><input><label>Mail</label></form>
<div id="comments"><p>first! {0}</p></div><footer>&copy; {0}</footer></body></html>"""
ARTICLE = "<article><h1>Title &amp; {0}</h1><p>one\n two&nbsp;{0}<br>three<p>four <b>five</b> 5 &lt; 6</p><div class='share'>Share</div><ul><li>a<li>b</ul><div hidden>gone</div></article>"


def test_article_text():
    text, _ = html_main.main_text(PAGE.format("x", ARTICLE.format("x")), [])
    assert text == "Title & x\n\none two x three\n\nfour five 5 < 6\n\na\n\nb"


def test_wrapper_finds_the_varying_slots():
    body = "<div class='box'><p>Read our daily letter</p><p>story {0} is long and new</p><p>more of {0} here</p><p>Call us any time</p></div>"
    refs = [html_main.parse(PAGE.format(k, body.format(k))) for k in ("r1", "r2")]
    text, n = html_main.main_text(PAGE.format("x", body.format("x")), refs)
    assert text == "story x is long and new\n\nmore of x here" and n >= 2
    alone, _ = html_main.main_text(PAGE.format("x", body.format("x")), [])
    assert alone == "Read our daily letter\n\nstory x is long and new\n\nmore of x here\n\nCall us any time"


def test_template_inside_an_article_goes_but_copies_stay():
    body = "<article><h1>H {0}</h1><p>Subscribe now</p>" + "<p>para {0} with many words of its own</p>" * 3 + "</article>"
    refs = [html_main.parse(PAGE.format(k, body.format(k))) for k in ("r1", "r2")]
    text, n = html_main.main_text(PAGE.format("x", body.format("x")), refs)
    assert "Subscribe" not in text and text.startswith("H x") and n >= 1
    same = [html_main.parse(PAGE.format("x", body.format("x")) + " " * k) for k in (1, 2)]
    assert "Subscribe" in html_main.main_text(PAGE.format("x", body.format("x")), same)[0]


def test_simple_tree_matching_counts():
    a, b = html_main.parse("<div><p>1</p><p>2</p><ul><li>x</li></ul></div>"), html_main.parse("<div><p>1</p><ul><li>x</li><li>y</li></ul></div>")
    assert html_main.align(a, b)[0] == 5  # root, div, p, ul, li


def test_odd_pages():
    for page in ("", None, "<", "<p", "plain text", "<article>", "<a href='x>y", "<div>" * 3000 + "deep" + "</div>" * 10, "</p></div>", "<script>never closed"):
        text, _ = html_main.main_text(page, [html_main.parse("<p>x</p>")])
        assert isinstance(text, str)
    assert html_main.main_text("<div>" * 3000 + "deep", [])[0] == "deep"
    assert html_main.main_text("plain &eacute; text", [])[0] == "plain é text"


def test_pages_of_the_fixture(spark):
    d = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = queries.op7_html_main(spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)
        parts = re.split(r"</?(?:p|h1)>", article[1]) if article else []
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert r["text"] == "\n\n".join(filter(None, want)) and r["n_chars"] == len(r["text"])


def test_html_clashing_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, None, "h"), (2, "http://A.example.com/x", "<p>hi</p>", "h"), (None, "//a.example.com", "<p>yo</p>", "h")], "page_id long, url string, html string, host string")
    got = sorted((str(r["page_id"]), r["text"]) for r in html_main.extract_main_text(df).collect())
    assert got == [("1", ""), ("2", "hi"), ("None", "yo")]
    assert html_main.extract_main_text(df.limit(0)).count() == 0


def test_alignment_decides_where_nothing_is_marked():
    """Pages whose tags and class names tell nothing: what the pages of a host share
    goes, what varies stays."""
    page = (
        "<body><div><span>The Daily</span><div>Home | World | Sport</div></div><div><div><p>Read more every day</p><h2>{0} happens</h2>"
        "<p>{0} was seen in town</p><p>By our staff</p><p>then {0} left again</p></div><div><p>Other stories</p></div></div><div>All rights reserved</div></body>"
    )
    refs = [html_main.parse(page.format(k)) for k in ("Rain", "Snow", "Wind", "Hail")]
    text, n = html_main.main_text(page.format("A bear"), refs)
    assert text == "A bear happens\n\nA bear was seen in town\n\nthen A bear left again" and n == 6
    other = page.format("A bear").replace("By our staff", "By Ann")  # only where most repeat it
    assert "By Ann" in html_main.main_text(other, refs)[0]


def test_one_copy_among_the_references_hides_no_template():
    body = "<article><h1>H {0}</h1><p>Subscribe now</p>" + "<p>para {0} with many words of its own</p>" * 3 + "</article>"
    refs = [html_main.parse(PAGE.format(k, body.format(k))) for k in ("r1", "r2", "x")]
    text, n = html_main.main_text(PAGE.format("y", body.format("x")), refs)
    assert "Subscribe" not in text and "para x" in text and n == 1


def test_labels_outside_forms_are_text():
    assert html_main.main_text("<article><p>Hello <label>world</label></p><fieldset>set</fieldset><form><label>no</label></form></article>", [])[0] == "Hello world\n\nset"


@pytest.mark.parametrize("kind", ["table", "list", "deep", "same"])
def test_wide_and_deep_pages_are_aligned_in_time(kind):
    import time

    def page(word, n):
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{word}{k}</td><td>fixed</td><td>{k % 7}</td></tr>" for k in range(n)) + "</table><p>end</p>"
        if kind == "list":
            return "<p>start</p><ul>" + "".join(f"<li>{word} {k}</li>" for k in range(n)) + "</ul><p>end</p>"
        if kind == "deep":
            return "<div>" * n + f"{word}<p>end</p>" + "</div>" * n
        return "<p>end</p>" + "<div><p>same</p></div>" * n + word

    began = time.monotonic()
    root, ref = html_main.parse(page("a", 16_000)), html_main.parse(page("b", 15_990))
    found = html_main.repeated_slots(root, ref)
    assert time.monotonic() - began < 40
    ends = [n for n in html_main.below([root]) if n.tag == "p" and html_main.own_text(n) == "end"]
    assert kind == "deep" or all(id(n) in found for n in ends)


def test_blocks_match_as_the_whole_where_anchors_stand():
    rows = [f"<li>{k}</li>" for k in range(200)]
    a, b = "<ul>" + "".join(rows) + "</ul>", "<ul>" + "".join(rows[:50] + ["<li>x</li>"] * 3 + rows[50:120] + rows[130:]) + "</ul>"
    assert html_main.align(html_main.parse(a), html_main.parse(b))[0] >= 2 + 190

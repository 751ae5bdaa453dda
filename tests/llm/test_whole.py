"""The whole job: inputs that no test table holds."""

import random
import signal

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlake.llm import bpe, chunks, decontam, html_main, langid, secrets, token_files


def test_language_of_a_text_of_megabytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.learn(docs.filter(~langid.held_out()))
    rows = docs.filter("lang = 'en' AND text IS NOT NULL").select("text").distinct().collect()
    text = "\n".join(sorted(r["text"] for r in rows))[:3_000_000]
    assert len(text) == 3_000_000
    df = spark.createDataFrame([(1, text), (2, text[:20_000])], "doc_id long, text string")
    for r in langid.classify(df, model).collect():
        assert r["lang_pred"] == "en" and not r["rejected"] and r["margin"] > 0.05
    assert b"".join(langid.pieces(b"abcdefg" * 11, 10)) == b"abcdefg" * 11 and langid.pieces(b"abc", 3) == [b"abc"]


def test_a_rare_label_leaves_the_other_languages_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs.filter(~langid.held_out()).select("text", "lang")
    rare = [("mi nombre es Ana y vivo aqui", "xx"), ("12345 67890", "yy")]
    model = langid.learn(known.unionByName(spark.createDataFrame(rare, "text string, lang string")))
    plain = langid.learn(known)
    assert set(model) == {*plain, "xx"} and all(model[k] == plain[k] for k in plain)
    held = docs.filter(langid.held_out() & (F.length("text") > 300))
    got, want = ({r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.classify(held, m).collect()} for m in (model, plain))
    assert got == want and len(got) > 100


def test_a_small_language_is_found_and_copies_do_not_hide_it(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text IS NOT NULL")
    few = docs.filter(~langid.held_out() & (F.col("lang") == "es") & (F.length("text") > 4000)).orderBy("doc_id").limit(1).select("text", "lang")
    known = docs.filter(~langid.held_out() & (F.col("lang") != "es")).select("text", "lang")
    copies = few.crossJoin(spark.range(10_000)).select("text", "lang")
    model = langid.learn(known.unionByName(copies))
    assert 3000 < len(model["es"]) < len(model["en"]) / 2
    held = docs.filter(langid.held_out() & (F.length("text") > 1000))
    rows = langid.classify(held, model, keep=["doc_id", "lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] and not r["rejected"] for r in rows) > 0.97 * len(rows)
    assert len({r["lang"] for r in rows}) == 4


def test_a_text_with_more_distinct_chunks_than_slots():
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    listed = " ".join(str(7919 * k) for k in range(5000))
    texts = ["short one", listed, "", listed.replace(" ", ",\n") + " ü  x ", "a,b"]
    signal.alarm(60)  # a full table was searched for ever
    try:
        for coder in (bpe.ReplayEncoder(ranks, P.PATTERN, bits=10), token_files.LibraryEncoder(P.path("byte_bpe_50k.json"), P.PATTERN, bits=10)):
            for end in (None, 0):
                ids, sizes = coder.encode(pa.array(texts), end)
                want = [plain.encode_ordinary(t) + ([end] if end is not None else []) for t in texts]
                assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    finally:
        signal.alarm(0)


def test_class_words_do_not_empty_a_page():
    body = "<p>one</p><p>two</p>"
    for page in (
        f'<html class="no-widget"><body class="has-sidebar search-results"><div>{body}</div></body></html>',
        f'<body><article class="post comments-open">{body}</article></body>',
        f'<body><main class="sidebar">{body}</main></body>',
        f'<body><div class="content no-sidebar">{body}</div><div class="sidebar">side</div></body>',
        f'<body><div class="sidebar-left"><article>{body}</article></div></body>',
        f'<body><div class="share-page"><div>{body}</div></div></body>',
    ):
        assert html_main.main_text(page, [])[0] == "one\n\ntwo", page
    page = f'<article>{body}</article><div id="comments"><article>first!</article></div><article class="ad">buy</article>'
    assert html_main.main_text(page, [])[0] == "one\n\ntwo"
    assert html_main.main_text(f'<div class="share-page">{body}<div class="ad">buy</div></div>', [])[0] == "one\n\ntwo"


def test_all_likely_parts_are_kept():
    posts = '<body><div>Home</div><div class="post"><p>first post here</p></div><p>and</p><div class="post"><p>second post</p><div class="content">inner</div></div></body>'
    assert html_main.main_text(posts, [])[0] == "first post here\n\nsecond post\n\ninner"
    entry = '<body><div class="entry-title">Title</div><div class="entry-content"><p>the long story</p></div></body>'
    assert html_main.main_text(entry, [])[0] == "Title\n\nthe long story"
    alone = '<body><div class="entry-title">Title</div><div><p>the long story</p></div></body>'
    assert html_main.main_text(alone, [])[0] == "Title\n\nthe long story"
    refs = [html_main.parse(posts.replace("first", k).replace("second", k).replace("inner", k)) for k in ("x", "y")]
    assert "second post" in html_main.main_text(posts, refs)[0]


def test_near_copies_are_no_template():
    page = "<body><p>{0}</p><div><p>a story of many words</p><p>with a second part</p></div><p>call us</p></body>"
    other = "<body><p>{0}</p><div><p>{0} something else that is long</p><p>{0} and so on</p></div><p>call us</p></body>"
    copies = [html_main.parse(page.format(k)) for k in ("9 May", "8 May", "7 May")]
    others = [html_main.parse(other.format(k)) for k in ("3 May", "2 May")]
    whole = "1 May\n\na story of many words\n\nwith a second part\n\ncall us"
    assert html_main.main_text(page.format("1 May"), copies[:1])[0] == whole
    assert html_main.main_text(page.format("1 May"), copies)[0] == whole
    assert html_main.main_text(page.format("1 May"), [*copies[:2], *others])[0] == whole.removesuffix("\n\ncall us")


def test_references_differ_in_content(spark):
    copy = "<body><p>{0}</p><p>a story of many words that was copied</p></body>"
    rows = [(k, "http://a/x", copy.format(k)) for k in range(300)]
    rows += [(1000 + k, "http://a/y", f"<body><p>{k}</p><p>another story {k} of some words, longer</p></body>") for k in range(30)]
    refs = html_main.reference_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html").first()["refs"]
    assert len(refs) > 2 and sum("copied" in r for r in refs) <= 1


def test_an_inner_secret_does_not_hide_the_outer_one():
    text = "token=" + "0123456789abcdef" * 2 + "Z" * 500 + " user=alice1"
    kept, links = secrets.link(text)
    ident = ("ident", text.index("user="), len(text))
    assert ident in kept and (ident, ("assign", 0, 538)) in links


def test_links_and_weak_spans_equal_brute_force():
    r = random.Random(7)
    pool = ["user=alice1", "login: bob22", "password=hunter22", "token='0123456789abcdef01234567Z'", "AKIA" + "A1B2" * 4, "0123456789abcdef" * 2]
    pool += ["aB3" * 8, "https://x.example.com/a", "s3://b/c", "word", "some words", "x" * 150, "y" * 390]
    for _ in range(400):
        text = " ".join(r.choice(pool) for _ in range(r.randint(1, 25)))
        base, weak = secrets.base_spans(text), secrets.weak_spans(text)
        over = lambda a, b: a[1] < b[2] and b[1] < a[2]
        parts = base + [w for w in weak if w[0] != "blob" or not any(over(w, x) for x in base)]
        meets = lambda a, b: not over(a, b) and max(a[1] - b[2], b[1] - a[2]) <= 2 * secrets.REACH
        role = secrets.ROLE
        pairs = [(p, q) for p in parts for q in parts if p != q and role[q[0]] in secrets.COMPLETES[role[p[0]]] and meets(p, q)]
        kept = {p for p in parts if p[0] in secrets.BASE or any(a == p and role[q[0]] in secrets.NEEDS[p[0]] for a, q in pairs)}
        got, links = secrets.link(text)
        assert set(got) == kept and len(got) == len(kept)
        assert sorted(links) == sorted((p, q) for p, q in pairs if p in kept and q in kept)


def test_all_partners_in_a_scope_are_linked():
    text = " ".join(["user=alice1", "user=bob222", "user=carol3", "password=hunter22", "password=hunter33"])
    assert len(secrets.link(text)[1]) == 12


def test_very_many_parts_take_linear_time():
    text = " ".join(f"{'aB3' * 7}{k} {'0123456789abcdef' * 2}" for k in range(20_000))
    signal.alarm(60)
    try:
        kept, _ = secrets.link(text)
    finally:
        signal.alarm(0)
    assert len(kept) >= 20_000


def test_a_written_end_token_is_as_by_the_library():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    r = random.Random(5)
    bits = ["<|endoftext|>", "<|endoftext|", "hello", " world", "  ", "\n", "é", ",", "x" * 40, "1", "<", "|>"]
    texts = ["hello <|endoftext|> world", "", "<|endoftext|>", "a<|endoftext|>"] + ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    for plain in (False, True):
        tok.encode_special_tokens = plain
        coder = token_files.LibraryEncoder(P.path("byte_bpe_50k.json"), P.PATTERN, bits=10, plain_added=plain)
        ids, sizes = coder.encode(pa.array(texts), 0)
        want = [[*e.ids, 0] for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_ids_do_not_rest_on_a_hash(monkeypatch):
    """All chunks share very few hashes, and the ids are right all the same."""
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    real = chunks.chunk_hashes
    monkeypatch.setattr(chunks, "chunk_hashes", lambda parts, sizes: real(parts, sizes) % np.uint64(5) + np.uint64(1))
    coder = bpe.ReplayEncoder(ranks, P.PATTERN, bits=10)
    r = random.Random(6)
    words = ["".join(r.choice("abcdeé") for _ in range(r.choice([3, 5, 40]))) for _ in range(60)]
    for _ in range(5):
        texts = [" ".join(r.choice(words) for _ in range(50)) for _ in range(20)]
        ids, _ = coder.encode(pa.array(texts))
        assert ids.tolist() == sum((plain.encode_ordinary(t) for t in texts), [])


def test_corpus_inventory_and_ids(spark, monkeypatch):
    """The inventory holds what is frequent, and ids are the same with any of it."""
    path = P.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    r = random.Random(4)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.choice([2, 4, 7, 40]))) for _ in range(300)]
    rows = [(i, " ".join(words[min(int(r.expovariate(0.02)), 299)] for _ in range(80)) + r.choice(["", " ", "\n\n", "  x"])) for i in range(120)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = {i: plain.encode_ordinary(t or "") for i, t in rows}
    for most in (0, 7, 100, 1 << 17):
        table = bpe.corpus_inventory(df, path, P.PATTERN, most=most)
        assert table.num_rows <= most and (most < 100 or table.num_rows > 50)
        for c, ids in zip(table.column("chunk").to_pylist(), table.column("ids").to_pylist()):
            assert ids == plain.encode_ordinary(c.decode())
        monkeypatch.setattr(bpe, "INVENTORY_CHUNKS", most)
        got = {x["doc_id"]: x for x in bpe.bpe_round_trip(df, path, P.PATTERN).collect()}
        assert {i: x["ids"] for i, x in got.items()} == want
        assert all(bytes(x["decoded"]).decode() == (dict(rows)[i] or "") for i, x in got.items())
    assert bpe.bpe_round_trip(df.limit(0), path, P.PATTERN).count() == 0


def test_a_loaded_store_survives_being_full():
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.ReplayEncoder(ranks, P.PATTERN, bits=8)
    known = [b" the", b" of", b" abc"]
    coder.load("a", pa.table({"chunk": known, "ids": [plain.encode_ordinary(c.decode()) for c in known]}))
    signal.alarm(60)
    try:
        for k in range(20):
            text = " the of " + " ".join(f"x{k}y{i} of" for i in range(150)) + " abc"
            ids, _ = coder.encode(pa.array([text]))
            assert ids.tolist() == plain.encode_ordinary(text)
    finally:
        signal.alarm(0)
    assert coder.store.kept[2] == 3


def test_decontamination_keeps_clashing_columns(spark):
    extra = ["_dc_matches", "_dc_n_words", "_dc_h", "c0", "c1", "lists"]
    item = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(1, "clean text", *extra), (2, item, *extra)], ["doc_id", "text", *extra])
    bench = spark.createDataFrame([(1, item), (2, "other words here")], "item_id long, text string")
    for block in (1 << 20, 10):
        rows = decontam.decontaminate(df, bench, block_bytes=block).collect()
        assert [r["doc_id"] for r in rows] == [1] and all(rows[0][c] == c for c in extra) and rows[0].__fields__ == df.columns
        marked = decontam.mark(decontam.find_matches(df, bench, block_bytes=block))
        assert sorted((r["doc_id"], r["_dc_n_words"], r["_dc_contaminated"], r["lists"]) for r in marked.collect()) == [(1, 2, False, "lists"), (2, 20, True, "lists")]


def test_all_suffixes_are_bisected_at_once():
    r = random.Random(12)
    text = np.array([r.randrange(4) for _ in range(400)] + [0], dtype=np.int64)
    order = decontam.suffix_array(text, 400)
    order = order[text[order] > 0]
    needles = np.array([[r.randrange(1, 5) for _ in range(5)] for _ in range(200)])
    low, high = decontam.bounds(text, order, needles)
    for n, a, b in zip(needles, low, high):
        want = {p for p in range(len(text) - 5) if (text[p : p + 5] == n).all()}
        assert set(order[a:b].tolist()) == want


def test_language_equals_a_plain_version(spark):
    """Each text with each dictionary, cut to one size, in whole pieces: the smallest sum wins."""
    import re

    import zstandard as zstd

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs.filter(~langid.held_out()))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10**9 + k, t) for k, t in enumerate([None, "", "123 !", "a", "ß" * 40_000])]
    size = min(map(len, model.values()))
    model = {k: v[-size:] for k, v in model.items()}  # one tier
    coders = {}
    for k, v in model.items():
        d = zstd.ZstdCompressionDict(v[-size:], dict_type=zstd.DICT_TYPE_RAWCONTENT)
        params = zstd.ZstdCompressionParameters.from_level(langid.LEVEL, dict_size=size, write_content_size=False, write_dict_id=False, write_checksum=False)
        d.precompute_compress(compression_params=params)
        coders[k] = zstd.ZstdCompressor(compression_params=params, dict_data=d)
    want = {}
    for i, t in rows:
        letters = re.sub(r"[\W\d_]+", " ", (t or "").lower())
        if not letters.strip():
            want[i] = ("und", True)
            continue
        data = letters.encode()
        n = -(-len(data) // langid.PIECE_BYTES)
        cut = [data[len(data) * k // n : len(data) * (k + 1) // n] for k in range(n)]
        sizes = sorted((sum(len(c.compress(p)) for p in cut), k) for k, c in coders.items())
        want[i] = (sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[0][0] < langid.MIN_MARGIN)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.classify(df, model).collect()} == want

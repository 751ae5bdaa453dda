"""Text operators against brute force, on a fixture with odd rows."""

import base64
import hashlib
import re
import struct
import zlib

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from ledgerlake.llm import bpe, decontam, exact_dedup, langid, queries, secrets, token_files
from ledgerlake.llm.common import scratch_path

HEX = "0123456789abcdef" * 3
DOCS = [
    (1, "Hello  world, it's 2024!\n\nthe end", "en", "a"),
    (2, "Hello world, it's 2024!\tthe end", "en", "a"),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, "Hello\x0b\x0cworld, it's 2024! the end", "fr", "a"),
    (6, f'say "token" = "{HEX}" and PASSWORD: hunter2 password=abc AKIA' + "A1" * 9, "en", "a"),
    (7, "ünï cödé 日本語 <|endoftext|> 'll don't   x", "de", None),
    (8, "a" * 5000 + " " + "xyzzy" * 400, "es", "a"),
    (9, "ﬀ     é \x1c\x1f\x85", "es", "a"),
    (9, "ﬀ     é \x1c\x1f\x85", "es", "a"),
    (None, "no id here", "en", "a"),
    (10, "user=alice1 secret: s3cr3tvalue https://api.example.com/v1", "en", "a"),
    (11, "see https://api.example.com/v1 and user=alice1", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, _id string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library_and_round_trips(spark, docs, encoding):
    got = bpe.bpe_round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = sorted((str(i), encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in DOCS)
    assert sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in got) == want


def test_bpe_real_documents(spark, encoding):
    sf = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_byte_bpe(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = encoding.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_replay_falls_back_when_a_merge_makes_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 290, b"xx": 256, b"xxx": 257}
    replay = bpe.MergeReplay(ranks)
    enc = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    words = ["zabcabcz", "abcq", "xxxxxq", "bcabcbc!", "q"]
    assert replay.encode_words([w.encode() for w in words]) == [enc.encode_ordinary(w) for w in words]
    assert [replay.encode_one(w.encode()) for w in words] == [enc.encode_ordinary(w) for w in words]


def brute_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_secrets_base_spans_on_documents(spark, sf):
    d = f"/root/testdata/{sf}"
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.op3_secret_scan(spark, d).collect():
        want = brute_base(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == (want.count(",") + 1 if want else 0)
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_secrets_weak_parts_need_a_partner(docs):
    got = {r["doc_id"]: r for r in secrets.scan_secrets(docs).collect()}
    kinds = lambda i: [s["kind"] for s in got[i]["spans"]]
    assert kinds(6) == ["assign", "hex", "assign", "access"] or sorted(kinds(6)) == sorted(["assign", "hex", "assign", "access"])
    assert kinds(10) == ["ident", "assign", "endpoint"]
    assert got[10]["links"]
    assert kinds(11) == []  # an address and an identifier, but no secret
    assert kinds(3) == kinds(4) == []


def test_secrets_scope_and_nearest():
    far = "secret=abcdef123" + " " * 500 + "user=alice1"
    assert [k for k, *_ in secrets.link(far)[0]] == ["assign"]
    near = "secret=abcdef123" + " " * 100 + "user=alice1"
    spans, links = secrets.link(near)
    assert [k for k, *_ in spans] == ["assign", "ident"] and len(links) == 2


def test_exact_dedup_fixture(docs):
    rows = exact_dedup.exact_dedup(docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in DOCS:
        groups.setdefault(norm(t), []).append(i)
    assert len(rows) == len(DOCS)
    by = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in rows:
        ids = by[r["text_sha256"]]
        keep = min((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)


def test_exact_dedup_rounds_agree_for_any_fan(docs):
    want = sorted(map(str, exact_dedup.exact_dedup(docs).collect()))
    for runs, bits in ((1, 1), (7, 1), (64, 2)):
        assert sorted(map(str, exact_dedup.exact_dedup(docs, runs=runs, fan_bits=bits).collect())) == want


def brute_hits(docs, items, window=13):
    w = decontam.words_of
    out = {}
    for i, t in docs:
        words, hit, ids = w(t), set(), set()
        for key, x in items:
            x = w(x)
            k = min(window, len(x))
            for j in range(len(x) - k + 1) if x else ():
                for p in range(len(words) - k + 1):
                    if words[p : p + k] == x[j : j + k]:
                        hit.update(range(p, p + k))
                        ids.add(str(key))
        out[i] = (len(words), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(words))
    return out


def test_decontamination_brute_force(spark):
    import random

    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(6)]
    long_item = [rnd.choice(vocab) for _ in range(30)]
    items = [(1, " ".join(long_item)), (2, "Short Item here"), (3, None), (4, ""), (5, " ".join(long_item[5:25])), (6, "solo"), (6, "w0 w0")]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(60))) for i in range(20)]
    docs += [(100, "x " * 30 + " ".join(long_item[3:20]) + " y" * 30 + " SHORT, item-here"), (101, " ".join(long_item * 2)), (102, None), (103, ""), (104, "solo")]
    docs += [(105, " ".join(long_item[:13]) + " z" * 300)]
    want = brute_hits(docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block, shard in ((1 << 20, 1 << 20), (40, 200)):
        rows = decontam.mark(decontam.find_matches(d, b, block_bytes=block, shard_bytes=shard)).collect()
        got = {
            r["doc_id"]: (r["_dc_n_words"], r["_dc_n_hit"], sorted({m["item"] for m in r["_dc_matches"]}), r["_dc_contaminated"])
            for r in rows
        }
        assert got == want
    kept = {r["doc_id"] for r in decontam.decontaminate(d, b).collect()}
    assert kept == {i for i, x in want.items() if not x[3]}
    assert decontam.decontaminate(d, b.limit(0)).count() == len(docs)
    assert decontam.decontaminate(d.limit(0), b).count() == 0


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op6_decontamination"])
def test_sql_twins(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_token_files(spark, docs):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    path = scratch_path(spark, "t")
    token_files.write_tokens(docs, path, P.path("byte_bpe_50k.json"), P.PATTERN)
    rows = token_files.checked_tokens(spark, path).collect()
    order = sorted(rows, key=lambda r: r["start"])
    ids = [r["doc_id"] for r in order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(DOCS)
    at = 0
    text = {i: t or "" for i, t, *_ in DOCS}
    for r in order:
        want = [*tok.encode(text[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"]) == (at, len(want))
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(want)}I", *want))
        at += len(want)
    starts = {(r["doc_id"], r["start"], r["n_tokens"]) for r in token_files.document_starts(spark, path).collect()}
    assert starts == {(r["doc_id"], r["start"], r["n_tokens"]) for r in rows}
    plan = token_files.read_tokens(spark, path, ["doc_id", "n_tokens"]).filter("doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan


def test_token_files_layout(spark, docs):
    import glob

    import pyarrow.parquet as pq

    path = scratch_path(spark, "t")
    token_files.write_tokens(docs.coalesce(1), path, P.path("byte_bpe_50k.json"), P.PATTERN)
    metas = [pq.ParquetFile(f).metadata for f in glob.glob(path.removeprefix("file://") + "/*.parquet")]
    cols = [m.row_group(0).column(3) for m in metas if m.num_row_groups]
    assert cols and all("DELTA_BINARY_PACKED" in c.encodings and c.has_column_index for c in cols)


def test_language_id(spark, docs):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    tested = [r for r in rows if r["held_out"] and truth[r["doc_id"]]["lang"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in tested)
    assert right / len(tested) > 0.95
    model = langid.learn(docs)
    got = {r["doc_id"]: r for r in langid.classify(docs, model).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[3]["rejected"]
    assert {r["lang_pred"] for r in langid.classify(docs, {}).collect()} == {"und"}
    assert langid.classify(docs.limit(0), model).count() == 0 and langid.learn(docs.limit(0)) == {}


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert secrets.scan_secrets(none).count() == 0
    assert bpe.bpe_round_trip(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    path = scratch_path(spark, "t")
    token_files.write_tokens(none, path, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert token_files.checked_tokens(spark, path).count() == 0


def test_ranks_file_is_base64():
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    assert len(ranks) == 50256 and ranks[base64.b64decode("IQ==")] == 0


def test_chunks_equal_the_libraries_on_odd_texts(encoding):
    import random

    import pyarrow as pa

    rnd = random.Random(8)
    letters = " \n\tab'sé.1,—’_\r\x85l" + "d"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(4000)] + ["", " ", "  ", "a ", "\n b", "\n  b", "x" * 500, "it's  'll"]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    for coder, plain, end in (
        (bpe.ReplayEncoder(ranks, P.PATTERN, bits=10), encoding.encode_ordinary, None),
        (token_files.LibraryEncoder(P.path("byte_bpe_50k.json"), P.PATTERN, bits=10), lambda t: tok.encode(t, add_special_tokens=False).ids, 0),
    ):
        for k in range(0, len(texts), 97):
            part = texts[k : k + 97]
            ids, sizes = coder.encode(pa.array(["cut off", *part]).slice(1), end)
            at = 0
            for t, n in zip(part, sizes):
                assert ids[at : at + n].tolist() == plain(t) + ([end] if end is not None else []), t
                at += n

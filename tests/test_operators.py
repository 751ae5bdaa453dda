"""Unit vectors for names, layouts, statements, overrides, scope and streams.
All names are invented."""

import itertools
from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.functions import columns as c
from ledgerlake.functions import layout, names
from ledgerlake.operators import balances, ledger, metrics, normalize, overrides, parsing, resolver, scope
from ledgerlake.operators.prefix import running
from ledgerlake.plans import modules
from ledgerlake.sources import sinks, statements
from ledgerlake.streaming import daily


@pytest.mark.parametrize(
    "narration,entity,confidence",
    [
        ("UPI SETTLEMENT -WW8951- 03/04/24", "UPI SETTLEMENT", 85),
        ("SMS_CHARGE_FOR_JAN25", "BANK CHARGES", 85),
        ("MOB ZOMATO 123", "ZOMATO", 95),
        ("TRANSFER TO SELF", "SELF / INTERNAL TRANSFER", 80),
        ("UPI-ALPHA BETALINE-123456@ybl", "ALPHA BETALINE", 90),
        ("CASH DEPOSIT BY - GAMMA DELTAIN - 0042", "GAMMA DELTAIN", 92),
        ("CREDIT CARD", "CREDIT", 85),
    ],
)
def test_party_of_narration(narration, entity, confidence):
    found = names.from_transaction("", narration)
    assert found.entity == entity and found.confidence >= confidence


def test_texts_that_differ_in_a_reference_are_resolved_once(monkeypatch):
    asked = []
    ladder = names.ladder
    monkeypatch.setattr(names, "ladder", lambda p, n: asked.append(n) or ladder(p, n))
    names.resolved_shape.cache_clear()
    for form in ("UPI-ALPHA BETALINE-{}-@ybl", "IMPS/P2A/{}/GAMMA DELTAIN", "NEFT/OMEGA SIGMA/{}"):
        texts = [form.format(k) for k in (123456, 654321, 999111, 471108)]
        assert [names.resolved("", x) for x in texts] == [ladder("", x) for x in texts]
    assert len(asked) == 3
    for x in ("SBIN-1800123456-ALPHA", "ABCD012345 ALPHA", "HDFC0001234 BETA", "24 X 7 123456 GAMMA", "1STATEMENT PERIOD : 2024-01-01800123456"):
        assert names.resolved("", x) == ladder("", x)


def test_resolved_rows_keep_their_order_and_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "UPI-ALPHA BETALINE-123456-@ybl"), (3, None, "MOB ZOMATO 123"), (4, "", "UPI-ALPHA BETALINE-654321-@ybl")], "k int, p string, n string")
    got = [r["e"] for r in df.coalesce(1).select("k", ledger.resolved("p", "n")["entity"].alias("e")).orderBy("k").collect()]
    assert got == ["UNRECOGNIZED", "ALPHA BETALINE", "ZOMATO", "ALPHA BETALINE"]


def test_party_details():
    assert names.from_transaction("", "ACH D- ALPHA EMI") == ("EMI PAYMENT", 80)
    assert names.from_text("CLOSING BALANCE 1,000.00") == names.NOTHING
    assert names.bare("omegaperson8983") == "omegaperson" and names.bare("NO.") == "NO"
    assert names.normalized("alpha asso") == "ALPHA ASSOCIATES"
    assert names.normalized("and") == names.UNKNOWN and names.normalized("bank charges") == "BANK CHARGES"
    assert names.cluster_key("S S ALPHABETA MUMBAI") == names.cluster_key("ALPHABETA")
    assert names.merchant("OLA BUS", rails=False) is None and names.merchant("OLA CABS", rails=False) == "OLA"
    assert names.merchant("CREDIT", rails=False) is None
    assert names.garbage("HDFC0001234567890") and not names.garbage("ALPHA TRADERS")


def plain_clusters(labels):
    """The same greedy clustering without candidate pieces."""
    seeds = sorted(dict.fromkeys(labels), key=len, reverse=True)
    out = {}
    for label in seeds:
        key = names.cluster_key(label)
        if key in out:
            continue
        best, related = label, [key]
        for other in seeds:
            k = names.cluster_key(other)
            if other != label and k not in related and names.similar_keys(key, k):
                best = other if len(other) > len(best) else best
                related.append(k)
        shown = names.display(best)
        for k in related:
            out[k] = shown
    return out


def test_clusters_equal_the_plain_version():
    first = ["ALPHABETA", "ALPHABETTA", "GAMMADELTA", "OMEGALINE"]
    last = ["SIGMATAU", "SIGMATA", "KAPPAZETA", "KAPPA", ""]
    labels = [f"{a} {m} {b}".strip() for a, m, b in itertools.product(first, ["", "PRIVATE"], last)] + ["BANK CHARGES", "UNRECOGNIZED", "ALPHABETA"]
    assert names.clusters(labels) == plain_clusters(labels)
    shown = names.clusters(["OMEGALINE KAPPAZETA", "OMEGALINE KAPPA", "SIGMATAU PERSON"])
    assert shown["OMEGALINE KAPPA"] == "OMEGALINE KAPPAZETA" and shown["SIGMATAU PERSON"] == "SIGMATAU PERSON"


def test_similarity_columns_equal_python(spark):
    words = ["ECONOMY BRASS", "ECONOM BRASS", "STANDARD TIN", "TIN", "ECONOMY", "", "BRASS ECONOMY STEEL"]
    df = spark.createDataFrame(list(itertools.product(words, words)), "a string, b string")
    rows = df.select("a", "b", c.word_overlap(F.col("a"), F.col("b")).alias("s"), c.is_close_affix(F.col("a"), F.col("b")).alias("f")).collect()
    for r in rows:
        x, y = dict.fromkeys(r["a"].split()), dict.fromkeys(r["b"].split())
        want = sum(any(names.words_match(w, v) for v in y) for w in x) / max(len(x), len(y)) if x and y else 0.0
        assert abs(r["s"] - want) < 1e-9 and r["f"] == names.close_affix(r["a"], r["b"])


GENERIC = """ALPHA BANK
Account Name : ALPHA PERSON
A/C Number : 00123456
Date Particulars Amount Balance
OPENING BALANCE 1,000.00
01/04/2024 UPI-ALPHA TRADERS-123456@ybl 250.00 750.00
continued remark
02/04/2024 NEFT CR BETA 1,00,000.00 1,00,750.00
Page 1 of 2
'03-Apr-24 CHQ PAID 000123 750.00 0.00 1,00,000.00
Closing balance 1,00,000.00
04/04/2024 AFTER THE END 1.00 2.00"""


def as_lines(text):
    return [(x, []) for x in text.split("\n")]


def test_generic_layout():
    name, rows = layout.parse_statement(as_lines(GENERIC))
    assert name == "generic" and len(rows) == 3
    assert (rows[0].date, rows[0].withdrawal, rows[0].deposit, rows[0].balance) == (date(2024, 4, 1), 250.0, None, 750.0)
    assert rows[0].particulars == "UPI-ALPHA TRADERS-123456@ybl continued remark"
    assert (rows[1].withdrawal, rows[1].deposit) == (None, 100000.0)
    assert (rows[2].date, rows[2].withdrawal, rows[2].particulars, rows[2].cheque_no) == (date(2024, 4, 3), 750.0, "CHQ PAID", "000123")
    assert dict(layout.account_info(GENERIC.split("\n")))["Account Number"] == "00123456"
    assert layout.printed_totals(["Grand Total 1,000.00 2,000.00", "Closing balance 3,000.00"]) == (1000.0, 2000.0, 3000.0)


def test_columns_by_coordinates():
    items = [(10, "Date"), (50, "Particulars"), (200, "Debit"), (300, "Credit"), (400, "Balance")]
    row = "01/04/2024 X PAYMENT 250.00 750.00"
    lines = [("Date Particulars Debit Credit Balance", items), (row, [(10, "01/04/2024"), (310, "250.00"), (400, "750.00")])]
    (r,) = layout.parse_generic(lines)
    assert (r.withdrawal, r.deposit) == (None, 250.0)


def test_other_layouts():
    newest = ["Bank of Baroda", "03/04/2024 C 5.00 120.00", "02/04/2024 B 30.00 125.00", "01/04/2024 A 95.00 95.00"]
    name, rows = layout.parse_statement([(x, []) for x in newest])
    assert name == "newest_first" and [(r.withdrawal, r.deposit) for r in rows[:2]] == [(5.0, None), (None, 30.0)]
    split = ["DCB Bank", "Opening Balance 100.00", "01-04-2024", "ALPHA SHOP", "40.00 60.00", "02-04-2024 BETA", "15.00", "75.00", "03-04-2024 BAD", "1.00 9.00"]
    name, rows = layout.parse_statement([(x, []) for x in split])
    assert [(r.withdrawal, r.deposit, r.balance) for r in layout.parse_split([(x, []) for x in split])] == [(40.0, None, 60.0), (None, 15.0, 75.0)]
    sections = ["TRANS DATE", "01/04/2024", "02/04/2024", "DESCRIPTION", "ALPHA", "BETA", "BALANCE", "100.00", "150.00", "120.00"]
    rows = layout.parse_sections([(x, []) for x in sections])
    assert [(r.particulars, r.withdrawal, r.deposit) for r in rows] == [("ALPHA", None, 50.0), ("BETA", 30.0, None)]
    queues = ["TRANSACTION DATE", "01/04/2024", "02/04/2024", "03/04/2024", "PARTICULARS", "BY CREDIT ALPHA", "BETA", "GAMMA DEPOSIT", "WITHDRAWALS", "20.00", "DEPOSITS", "50.00", "5.00"]
    name, rows = layout.parse_statement([(x, []) for x in queues])
    assert name == "queues" and [(r.withdrawal, r.deposit, r.balance) for r in rows] == [(None, 50.0, 50.0), (20.0, None, 30.0), (None, 5.0, 35.0)]
    prefixed = ["Tran Date Chq No Particulars Debit Credit Balance", "UPI/ALPHA/123", "01/04/2024 10.00 90.00", "UPI/BETA/456", "02/04/2024 20.00 110.00"]
    assert [r.particulars for r in layout.parse_generic([(x, []) for x in prefixed])] == ["UPI/ALPHA/123", "UPI/BETA/456"]
    assert layout.parse_statement([]) == ("sections", []) or layout.parse_statement([])[1] == []


def test_line_table_and_word_clusters(spark):
    lines = spark.createDataFrame([("f", 1, i, x, None) for i, x in enumerate(GENERIC.split("\n"))], "file_id string, page_no int, line_no int, text string, items array<struct<x:double,text:string>>")
    assert [r["balance"] for r in parsing.parse_lines(lines).orderBy("row_no").collect()] == [750.0, 100750.0, 100000.0]
    assert parsing.account_info(lines).filter("label = 'Account Name'").first()["value"] == "ALPHA PERSON"
    assert parsing.printed_totals(lines).first()["closing_balance"] == 100000.0
    words = [("f", 1, 0, 50.0, 700.0, "B"), ("f", 1, 1, 10.0, 701.5, "A"), ("f", 1, 2, 10.0, 650.0, "C")]
    got = parsing.cluster_items(spark.createDataFrame(words, "file_id string, page_no int, item_no int, x double, y double, text string")).orderBy("line_no").collect()
    assert [r["text"] for r in got] == ["A B", "C"]


def test_statements(spark, tmp_path):
    doc = (
        '{"analysis_id":"a","applicantName":"APP","statements":[{"fileName":"x.pdf","accountInfo":[{"label":"Bank","value":"HDFC BANK LTD"},{"label":"Account Number","value":"000-1234"}],'
        '"transactions":[{"date":"2024-04-01","particulars":"","narration":"SALARY ALPHA","deposit":10.5,"withdrawal":null,"balance":null},'
        '{"date":"bad","deposit":1.0},{"date":"02/04/2024","deposit":0.0,"withdrawal":0.0},{"date":"31-02-24","deposit":5.0,"withdrawal":5.0,"balance":-3.0}]}]}'
    )
    (tmp_path / "s.json").write_text(doc + "\n{broken\n")
    rows = normalize.normalize(statements.read_statements(spark, str(tmp_path / "s.json"))).orderBy("txn_id").collect()
    assert [(r["txn_id"], r["date_text"], r["narration"], r["direction"], str(r["amount"])) for r in rows] == [
        ("1-1", "2024-04-01", "SALARY ALPHA", "Credit", "10.50"),
        ("1-4", "2024-03-02", "TRANSACTION", "Credit", "5.00"),
    ]
    assert (rows[0]["bank_name"], rows[0]["account_suffix"], rows[0]["holder"], rows[0]["category"]) == ("HDFC Bank", "1234", "APP", "Salary")


def test_null_balances_in_month_metrics(spark):
    df = spark.createDataFrame(
        [(1, 1, date(2024, 1, 1), 10, 0, None), (1, 2, date(2024, 1, 2), 0, 4, None)], "account_id long, seq long, txn_date date, credit int, debit int, balance int"
    )
    for x in ("credit", "debit", "balance"):
        df = df.withColumn(x, F.col(x).cast("decimal(18,2)"))
    df = df.select("*", F.lit("2024-01").alias("month_key"), F.lit("Jan-24").alias("month"), F.lit("UPI").alias("mode"), F.lit("x").alias("category"))
    r = metrics.month_metrics(df).first()
    assert (r["opening_balance"], r["closing_balance"], r["mean_balance"], r["upi_credit"]) == (0.0, 6.0, 0.0, 10.0)


def test_running_over_buckets(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), "id", (F.col("id") % 10).cast("decimal(18,2)").alias("v"))
    got = running(df, ["g"], F.floor(F.col("id") / 37), ["id"], "n", {"s": F.col("v")}).orderBy("g", "id").collect()
    sums = {0: 0, 1: 0}
    count = {0: 0, 1: 0}
    for r in got:
        sums[r["g"]] += r["v"]
        count[r["g"]] += 1
        assert (r["s"], r["n"]) == (sums[r["g"]], count[r["g"]])


def test_parties_by_user_and_resolver(spark):
    rows = [("t1", 1, "UPI-ALPHA BETALINE-1@ybl", "Zeta Shop", None, None), ("t2", 2, "UPI-ALPHA BETALINE-2@ybl", None, "gamma house", 0.0), ("t3", 3, "UPI-ALPHA BETALINE-3@ybl", None, None, True)]
    df = spark.createDataFrame([(1, a, b, date(2024, 1, b), n, cp, ap, True if ex is True else False) for a, b, n, cp, ap, ex in rows], "account_id long, txn_id string, seq long, txn_date date, narration string, custom_party string, ai_party string, excluded boolean")
    df = df.select("*", F.lit("UPI").alias("mode"), F.lit("Trade Debit").alias("category"), F.lit(1).cast("decimal(18,2)").alias("debit"), F.lit(0).cast("decimal(18,2)").alias("credit"))
    got = {r["party"]: r for r in ledger.party_ledger(df).collect()}
    assert set(got) == {"Zeta Shop", "GAMMA HOUSE"}
    assert got["Zeta Shop"]["confidence"] == 100 and got["Zeta Shop"]["category"] == "USER ASSIGNED"
    assert got["GAMMA HOUSE"]["confidence"] == 90 and got["GAMMA HOUSE"]["category"] == "AI ASSIGNED"


def test_party_changes(spark):
    parties = spark.createDataFrame([(1, 1, "Alpha"), (1, 2, "Beta")], "account_id long, party_id long, name string")
    fresh = spark.createDataFrame([(1, " alpha "), (1, ""), (1, "Gamma")], "account_id long, name string")
    assert sorted(r["name"] for r in overrides.add_parties(parties, fresh).collect()) == ["Alpha", "Beta", "Gamma"]
    assert sorted(r["name"] for r in overrides.rename_party(parties, 1, "beta").collect()) == ["Alpha", "Beta"]
    assert sorted(r["name"] for r in overrides.rename_party(parties, 1, "Delta").collect()) == ["Beta", "Delta"]
    txns = spark.createDataFrame([(1, "a"), (1, "b")], "account_id long, txn_id string")
    ids = spark.createDataFrame([(1, "a"), (1, "zz")], "account_id long, txn_id string")
    assert [r["txn_id"] for r in overrides.bulk_events(txns, ids, "assign", "P", 7).collect()] == ["a"]


def test_scope_and_modules(spark):
    df = spark.createDataFrame([("2024-01", "Jan-24"), ("2024-02", "Feb-24")], "month_key string, month string")
    assert scope.scope_month(df, "Jan-24").count() == 1 and scope.scope_month(df, "1999-01").count() == 2 and scope.scope_month(df, None).count() == 2
    assert scope.scope_rows(df, "2024-02").count() == 1
    keys = spark.createDataFrame([("Jan-24",), ("2024-03",), ("Feb-60",), ("x",)], "l string").select(c.key_of_label(F.col("l")).alias("k")).collect()
    assert [r["k"] for r in keys] == ["2024-01", "2024-03", "1960-02", None]
    assert modules.module("no-such", df).first()["sheet"] == "No Such"


def test_resolver(spark):
    assert [len(b) for b in resolver.batches([{"a": "x" * 100}] * 130)] == [60, 60, 10]
    assert resolver.object_in('say {"a": 1} end') == {"a": 1} and resolver.object_in("none") == {}

    def picky(rows):
        if len(rows) > 1 or rows[0]["txn_id"] == "bad":
            raise ValueError
        return [{"txn_id": rows[0]["txn_id"], "party": "P", "ledger": None, "confidence": None}]

    got = resolver.asked([{"txn_id": x} for x in ("a", "bad", "b")], picky)
    assert [(r["txn_id"], r.get("party"), r.get("error")) for r in got] == [("a", "P", None), ("bad", None, "ValueError: "), ("b", "P", None)]
    t = spark.createDataFrame([("a", "n", "Credit", 1.0, "UPI")], "txn_id string, narration string, direction string, amount double, mode string")
    assert resolver.resolve_parties(t, None).count() == 0 and resolver.resolve_parties(t, picky).first()["party"] == "P"


def test_sinks_and_stream(spark, tmp_path):
    names_ = spark.createDataFrame([("A/B",), ("a b",), ("x" * 40,)], "n string")
    assert sorted(r["sheet"] for r in sinks.sheet_names(names_, "n").collect()) == sorted(["A B", "a b 2", "x" * 28])
    events = spark.range(50).select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id)").alias("ts"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"))
    src = str(tmp_path / "src")
    events.write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = daily.start(daily.daily_totals(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    table = {str(r["day"]): r["n"] for r in daily.daily_totals(spark.read.parquet(src)).collect()}
    out = {str(r["day"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out.items() <= table.items() and sum(table.values()) == 50


def test_money_columns(spark):
    df = spark.createDataFrame([(1.005,), (-1.005,), (float("nan"),), (None,), (12345678.9,), (250000.0,)], "x double")
    assert [r[0] for r in df.select(c.round2(F.col("x"))).limit(2).collect()] == [1.01, -1.0]
    assert [r[0] for r in df.select(c.money(F.col("x"))).collect()][2:4] == [0.0, 0.0]
    assert [r[0] for r in df.select(c.inr(F.col("x"))).collect()][4:] == ["Rs 1.23 Cr", "Rs 2.50 L"]
    texts = spark.createDataFrame([("1,23,456.00",), ("-5.00",), ("12.00 Dr",), ("x",)], "t string")
    assert [str(r[0]) for r in texts.select(c.amount_of_text(F.col("t"))).collect()] == ["123456.00", "-5.00", "-12.00", "None"]


def test_balances_do_not_depend_on_buckets(spark, monkeypatch):
    rows = [(k % 3, k, date(2024, 1, 1 + k % 28), None if k % 11 == 0 else k * 7 % 50, k % 5) for k in range(400)]
    df = spark.createDataFrame(rows, "account_id long, seq long, txn_date date, balance int, amount int")
    df = df.select("account_id", "seq", "txn_date", F.col("balance").cast("decimal(18,2)"), F.col("amount").cast("decimal(18,2)"), F.lit("x").alias("narration"))
    wide = [sorted(map(str, f(df).collect())) for f in (balances.infer_side, lambda t: balances.reconcile_running(t, F.lit(0)), balances.from_balances)]
    monkeypatch.setattr(balances, "BUCKET_ROWS", 7)
    assert wide == [sorted(map(str, f(df).collect())) for f in (balances.infer_side, lambda t: balances.reconcile_running(t, F.lit(0)), balances.from_balances)]
    w = Window.partitionBy("account_id").orderBy("seq")
    for ahead, f in ((False, F.lag), (True, F.lead)):
        got = balances.with_neighbour(df, ("account_id",), ahead, "x").select("seq", "x").collect()
        assert sorted(map(str, got)) == sorted(map(str, df.select("seq", f("balance").over(w).alias("x")).collect()))


def test_uploads_beyond_the_limit_keep_a_reason(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(statements, "UPLOAD_BYTES", 4)
    for name, data in (("a.pdf", b"123"), ("b.png", b"12345"), ("c.txt", b"1")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"][-5:]: (r["kind"], r["content"], r["error"]) for r in statements.read_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("pdf", bytearray(b"123"), None), "b.png": ("image", None, "file too large")}

"""Facts that a plan uses in several places are joined and numbered once."""

from ledgerlake import queries

SF = "/root/testdata/sf0.001"


def test_kept_facts_are_read_from_one_table(spark, monkeypatch):
    monkeypatch.setattr(queries, "QUERIES", {})
    queries.over_txns("thrice", lambda t: t.unionByName(t).unionByName(t), keep="account_id seq")
    got = queries.QUERIES["thrice"](spark, SF)
    assert got.columns == ["account_id", "seq"] and got.count() == 3 * 6000
    assert not any("lineitem" in f or "orders" in f for f in got.inputFiles())

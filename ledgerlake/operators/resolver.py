"""A pluggable external resolver of parties; off unless one is given."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_CHARS = 60, 45_000
ROW = "txn_id string, party string, ledger string, confidence double, error string"


def batches(rows: list[dict], most_rows: int = BATCH_ROWS, most_chars: int = BATCH_CHARS) -> Iterator[list[dict]]:
    """Greedy packing by number and size; a row that is too large goes alone."""
    held, size = [], 0
    for r in rows:
        n = len(json.dumps(r))
        if held and (len(held) >= most_rows or size + n > most_chars):
            yield held
            held, size = [], 0
        held.append(r)
        size += n
    if held:
        yield held


def object_in(text: str) -> dict:
    """The JSON object of an answer, with or without words around it."""
    try:
        return json.loads(text)
    except ValueError:
        m = re.search(r"\{.*\}", text, re.S)
        return json.loads(m[0]) if m else {}


def asked(rows: list[dict], resolve: Callable[[list[dict]], list[dict]]) -> list[dict]:
    """Asks for a batch; one that fails is halved; a single row that fails comes
    back without a party and with the error."""
    try:
        return list(resolve(rows))
    except Exception as e:
        if len(rows) == 1:
            return [{"txn_id": rows[0]["txn_id"], "error": f"{type(e).__name__}: {e}"}]
        half = len(rows) // 2
        return asked(rows[:half], resolve) + asked(rows[half:], resolve)


def resolve_parties(txns: DataFrame, resolve: Callable[[list[dict]], list[dict]] | None) -> DataFrame:
    """(txn_id, party, ledger, confidence, error) from a resolver, which has to give the
    same answer when asked again; write the result before it is used twice."""
    if resolve is None:
        return txns.sparkSession.createDataFrame([], ROW)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = [r for part in batches(pdf.to_dict("records")) for r in asked(part, resolve)]
            known = set(pdf["txn_id"])
            told = {c: [r.get(c) for r in rows if r.get("txn_id") in known] for c in ("txn_id", "party", "ledger", "confidence", "error")}
            yield pd.DataFrame({c: pd.Series(v, dtype=float if c == "confidence" else object) for c, v in told.items()})

    compact = txns.select("txn_id", "narration", "direction", F.col("amount").cast("double").alias("amount"), "mode")
    return compact.mapInPandas(run, ROW)

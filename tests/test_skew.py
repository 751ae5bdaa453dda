"""The slope of a page is found in one small array, not by a row an angle and box."""

import math
import random

from pyspark.sql import functions as F

from ledgerlake.operators import boxes


def test_skew_multiplies_no_rows(spark):
    rng = random.Random(5)
    rows = []
    for page in range(6):
        slope = math.tan(math.radians((page - 3) * 0.5))
        for r in range(30):
            for k in range(4):
                y = r * 20 + k * 70 * slope + rng.randint(0, 2)
                rows.append(("f", page, k * 70.0, y, k * 70.0 + 60, y + 10, "w"))
    df = spark.createDataFrame(rows, "file_id string, page_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = boxes.page_skew(df)
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
    high = df.groupBy("page_no").agg(F.greatest(F.percentile_approx(F.col("y1") - F.col("y0"), 0.5) / 2, F.lit(1.0)).alias("bin"))
    high = {r["page_no"]: r["bin"] for r in high.collect()}
    for page, degrees in got.select("page_no", "degrees").collect():
        best = None
        for k in range(-20, 21):
            bins: dict[int, int] = {}
            for r in rows:
                if r[1] == page:
                    at = math.floor(((r[3] + r[5]) / 2 - (r[2] + r[4]) / 2 * math.tan(math.radians(k * 0.25))) / high[page])
                    bins[at] = bins.get(at, 0) + 1
            score = (sum(n * n for n in bins.values()), -abs(k), k)
            best = max(best, score) if best else score
        assert degrees == best[2] * 0.25

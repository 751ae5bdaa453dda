"""Words in boxes to lines of text, on pages that were scanned askew or upside down.

Skew: for each of a few angles the middles of a page's boxes are projected along it and counted in
bins of half the usual height; at the right angle words of a line fall into one bin,
so the sum of squares is greatest; a page's boxes are one small array in a task, so nothing is
multiplied by the angles.  Lines: after that turn, a sweep down the page opens a
line where no box still reaches; heights are taken a quarter narrower at each end, so
that lines which touch stay apart.  A page is a few arrays in one task.

Orientation: of several readings of a page the one with most date-like words, then the highest
confidence; a page is not read again once a reading shows enough dates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..sources.scratch import written
from .columnar import clean

PAGE = ["file_id", "page_no"]
MOST_DEGREES, STEP_DEGREES = 5.0, 0.25
SHRINK = 0.25


def steepest(y: np.ndarray, x: np.ndarray, high: np.ndarray, n: int, step: float) -> float:
    """Of 2 n + 1 angles the one at which the boxes of a page fall into the fewest bins."""
    known = np.sort(high[~np.isnan(high)])
    usual = max(known[math.ceil(len(known) / 2) - 1] / 2, 1.0) if len(known) else 1.0
    best, out = None, 0.0
    for k in range(-n, n + 1):
        counts = np.unique(np.floor((y - x * math.tan(math.radians(k * step))) / usual), return_counts=True)[1]
        score = (int((counts * counts).sum()), -abs(k), k)
        best, out = (score, k * step) if best is None or score > best else (best, out)
    return out


def page_skew(boxes: DataFrame, most: float = MOST_DEGREES, step: float = STEP_DEGREES) -> DataFrame:
    """(file_id, page_no, degrees): the slope of a page's lines; of equal ones the least."""
    n = round(most / step)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        degrees = steepest(pdf["y"].to_numpy(float), pdf["x"].to_numpy(float), pdf["high"].to_numpy(float), n, step)
        return pd.DataFrame([(*key, degrees)], columns=[*PAGE, "degrees"])

    kinds = ", ".join(f"{k} {boxes.schema[k].dataType.simpleString()}" for k in PAGE)
    middle, across = (F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2
    seen = boxes.select(*PAGE, middle.alias("y"), across.alias("x"), (F.col("y1") - F.col("y0")).alias("high"))
    return seen.groupBy(*PAGE).applyInPandas(run, f"{kinds}, degrees double")


def page_lines(most: float, step: float) -> Callable[[pa.Table], pa.Table]:
    """The lines of one page: its boxes are arrays of numbers and one of texts.  Nulls come first and numbers that are none
    last, as in a sort of the table."""
    n_angles = round(most / step)

    def run(page: pa.Table) -> pa.Table:
        page = page.combine_chunks()
        x0, y0, x1, y1 = (page[k].to_numpy() for k in ("x0", "y0", "x1", "y1"))
        there = [pc.is_valid(page[k]).to_numpy() for k in ("x0", "y0", "x1", "y1")]
        known, x_known = np.logical_and.reduce(there), there[0]
        text = page["text"].combine_chunks()
        rank = pc.rank(text, tiebreaker="dense").to_numpy()
        degrees = steepest((y0 + y1) / 2, (x0 + x1) / 2, y1 - y0, n_angles, step)
        shift, high = (x0 + x1) / 2 * math.tan(math.radians(degrees)), (y1 - y0) * SHRINK
        top, bottom = y0 - shift + high, y1 - shift - high
        down = np.lexsort((rank, x0, x_known, top, known))
        low = np.maximum.accumulate(np.where(known[down], bottom[down], -np.inf))
        reached = np.append(-np.inf, low[:-1])
        some = np.append(0, np.cumsum(known[down])[:-1]) > 0
        at = top[down]
        opens = ~known[down] | ~some | (at > reached) | (np.isnan(at) & ~np.isnan(reached))
        line = np.empty(len(down), np.int64)
        line[down] = np.cumsum(opens)
        across = np.lexsort((rank, x0, x_known, line))
        first = np.flatnonzero(np.diff(line[across], prepend=0))
        ends = pa.array(np.append(first, len(across)), pa.int32())
        words = text.take(pa.array(across)).cast(pa.string())
        items = pa.StructArray.from_arrays([page["x0"].combine_chunks().take(pa.array(across)), words], ["x", "text"])
        opened = down[opens]
        n = len(opened)
        keys = [page[k].take(pa.array(np.zeros(n, np.int64))) for k in PAGE]
        made = [pa.array(np.arange(1, n + 1), pa.int32()), pa.array(top[opened], pa.float64(), mask=~known[opened]), pc.binary_join(pa.ListArray.from_arrays(ends, words), " "), pa.ListArray.from_arrays(ends, items)]
        return pa.table([*keys, *made], names=[*PAGE, "line_no", "y", "text", "items"])

    return run


def lines_of_boxes(boxes: DataFrame, most: float = MOST_DEGREES, step: float = STEP_DEGREES) -> DataFrame:
    """(file_id, page_no, line_no, y, text, items) of boxes (file_id, page_no, x0, y0, x1, y1, text).

    The boxes of a page come to one task once, for its skew and its lines."""
    words = boxes.select(*PAGE, *[F.col(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")], clean(F.col("text")).alias("text")).filter("text <> ''")
    kinds = ", ".join(f"{k} {boxes.schema[k].dataType.simpleString()}" for k in PAGE)
    return words.groupBy(*PAGE).applyInArrow(page_lines(most, step), f"{kinds}, line_no int, y double, text string, items array<struct<x:double,text:string>>")


def reading_score(text: Column, confidence: Column) -> Column:
    return F.coalesce(c.date_tokens(text), F.lit(0)) * 1000 + F.coalesce(confidence, F.lit(0.0))


def best_readings(readings: DataFrame) -> DataFrame:
    """Of readings (file_id, page_no, turn, rotation, text, confidence) the best of each page; of equal ones the
    first tried (turn counts the tries)."""
    scored = readings.withColumn("score", reading_score(F.col("text"), F.col("confidence")))
    rest = [x for x in scored.columns if x not in PAGE]
    return scored.groupBy(*PAGE).agg(F.max_by(F.struct(*rest), F.struct(F.col("score"), -F.col("turn"))).alias("r")).select(*PAGE, "r.*")


def oriented(pages: DataFrame, read: Callable[[DataFrame, int], DataFrame], rotations: Sequence[int] = (0, 180), enough: int = 20) -> DataFrame:
    """Reads pages (file_id, page_no, ...) in one rotation after the other and keeps the best readings.

    read gives (file_id, page_no, text, confidence) for pages and a rotation; a page with ``enough``
    date-like words in a reading is not read in the rotations that follow."""
    left, found = pages, None
    for turn, rotation in enumerate(rotations):
        got = read(left, rotation).select(*PAGE, F.lit(turn).alias("turn"), F.lit(rotation).alias("rotation"), "text", F.col("confidence").cast("double").alias("confidence"))
        got = written(got, "page-readings")
        found = got if found is None else found.unionByName(got)
        left = left.join(got.filter(c.date_tokens(F.col("text")) >= enough).select(*PAGE), PAGE, "left_anti")
    return best_readings(found)

"""Language identification by compression.

Each learned language has a zstandard raw-content dictionary: a bounded sample
of its labelled texts.  A text is compressed once with every dictionary; the
language with the smallest output wins, and the prediction counts as rejected
when the margin to the runner-up is narrow or the text has no letter.  Long texts are compressed
in pieces of PIECE_BYTES at most, each with the dictionary anew, and the sizes
added up: a dictionary saves a bounded number of bytes, so in one run the margin
would shrink with the length of the text.

The sample is bounded by DICT_BYTES per language (documented parameter): labelled
texts are chosen by a hash of the text, copies once, at least one a language.
Counting distinct texts covers all rows.  Languages are compared with dictionaries
of one size, but none is cut below half of its text for that: languages with
less than half of the others' text form a tier of their own, in which the winner
so far takes part with its dictionary cut to their size.  Where that size is
under FAIR_BYTES, too little to compare by, the winner keeps its whole one.

Defined cases: a null, empty or letterless text is ``und`` with score 0 and
rejected; ties go to the language first by name; with no labelled text at all
every document is ``und``; with one language it wins with score 1.  Whole texts
are compressed, of any length.  Labels that are null teach nothing, nor do texts without a letter.  Only the
identifier and the text (and the label, for learning) are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty, tidied

DICT_BYTES = 112 << 10
PIECE_BYTES = 16 << 10
SAMPLE_TEXTS = 200
FAIR_BYTES = 3000
LEVEL = 9
UNDETERMINED = "und"
MIN_MARGIN = 0.004
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> bytes:
    """What is compressed: lower case, one space for all that is no letter, so
    that neither capitals nor numbers and markup count as language."""
    return NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def pieces(data: bytes, most: int = PIECE_BYTES) -> list[bytes]:
    """The whole of data in pieces of one size, of at most so many bytes."""
    n = -(-len(data) // most)
    return [data[len(data) * k // n : len(data) * (k + 1) // n] for k in range(n)]


def held_out(id_col: str = "doc_id") -> Column:
    """Documents of the test fold: crc32 of the identifier as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(
    labelled: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    dict_bytes: int = DICT_BYTES,
    sample_texts: int = SAMPLE_TEXTS,
) -> dict[str, bytes]:
    """Dictionaries by language, each of at most dict_bytes.

    The texts that come to the driver are bounded: about sample_texts a
    language, each cut to a sixteenth of the dictionary.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.filter(F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}")).withColumn("_hash", F.xxhash64("_text"))
    span = 1 << 30
    place = F.pmod(F.col("_hash"), F.lit(span))
    counts = rows.groupBy("_lang").agg(F.approx_count_distinct("_hash").alias("n"), F.min(place).alias("least")).collect()
    if not counts:
        return {}
    limits = {r["_lang"]: max(min(span, span * sample_texts // max(r["n"], 1)), r["least"] + 1) for r in counts}
    limit = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
    from_letter = F.regexp_extract("_text", rf"(?s)\p{{L}}.{{0,{dict_bytes // 16 - 1}}}", 0)
    picked = rows.filter(place < F.element_at(limit, F.col("_lang"))).groupBy("_lang", "_hash").agg(F.min(from_letter).alias("_text")).collect()
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for r in picked:
        texts.setdefault(r["_lang"], []).append((r["_hash"], letters_only(r["_text"])))
    return {k: b"\n".join(t for _, t in sorted(v))[-dict_bytes:] for k, v in sorted(texts.items())}


def tiers(model: dict[str, bytes]) -> list[tuple[int, list[str]]]:
    """(size, languages) from the largest dictionaries on: the languages of a tier
    have at least half of its largest dictionary and are cut to its smallest."""
    out: list[list[str]] = []
    for lang in sorted(model, key=lambda k: (-len(model[k]), k)):
        if out and 2 * len(model[lang]) >= len(model[out[-1][0]]):
            out[-1].append(lang)
        else:
            out.append([lang])
    return [(len(model[langs[-1]]), sorted(langs)) for langs in out]


def classify(
    docs: DataFrame,
    model: dict[str, bytes],
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    level: int = LEVEL,
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """id (and the columns in keep) with lang_pred, score, margin, rejected.

    margin is the part of the winner's size by which the runner-up is larger;
    score is margin / (margin + 0.02), between 0 and 1.
    """
    keep = [c for c in (keep or [id_col])]
    src = docs.select(text_or_empty(text_col).alias("_text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    schema = T.StructType(
        [
            *[T.StructField(c, src.schema[f"_k{i}"].dataType) for i, c in enumerate(keep)],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("margin", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    model = dict(sorted(model.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        made: dict[tuple[str, int], Callable[[bytes], bytes]] = {}
        levels = tiers(model)

        def size_of(parts: list[bytes], lang: str, size: int) -> int:
            f = made.get((lang, size))
            if f is None:
                raw = model[lang][-size:] if size else b""
                d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                params = zstd.ZstdCompressionParameters.from_level(
                    level, dict_size=len(raw), write_content_size=False, write_dict_id=False, write_checksum=False
                )
                d.precompute_compress(compression_params=params)
                f = made[lang, size] = zstd.ZstdCompressor(compression_params=params, dict_data=d).compress
            return sum(len(f(p)) for p in parts)

        def decide(parts: list[bytes]) -> tuple[str, float]:
            winner, at, margin = "", 0, float("inf")
            for size, langs in levels:
                sizes = [(size_of(parts, k, size), k) for k in langs]
                if winner:
                    at = size if size >= FAIR_BYTES else at
                    sizes.append((size_of(parts, winner, at), winner))
                sizes.sort()
                best, first = sizes[0]
                near = (sizes[1][0] - best) / best if len(sizes) > 1 else margin
                if first == winner:
                    margin = min(margin, near)
                else:
                    winner, at, margin = first, size, near
            return winner, margin

        for batch in batches:
            langs, scores, margins, rejected = [], [], [], []
            for value in batch.column(0):
                text = value.as_py()
                if not model or not LETTER.search(text):
                    langs.append(UNDETERMINED), scores.append(0.0), margins.append(0.0), rejected.append(True)
                    continue
                lang, margin = decide(pieces(letters_only(text)))
                margin = margin if len(model) > 1 else 1.0
                langs.append(lang)
                margins.append(margin)
                scores.append(margin / (margin + 0.02) if len(model) > 1 else 1.0)
                rejected.append(margin < min_margin)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(margins, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                [f.name for f in schema],
            )

    return src.mapInArrow(tidied(run), schema)

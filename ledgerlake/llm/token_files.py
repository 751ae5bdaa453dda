"""Token files: Parquet list columns with delta encoding, controlled row
groups and pages, and page indexes.

Documents are range-partitioned and sorted by identifier, encoded with the
tokenizers library, ended with an end id, and written as
``(id, n_tokens, at, ids array<int>)``; ``at`` is the number of ids before the
document inside its file, kept so that a reader finds any document's place
without reading the ids before it.  The writer turns the dictionary off for the
ids and takes format version 2, which stores them delta-packed, and writes a
column index per page; row groups and pages have fixed target sizes.  A reader
that selects metadata columns never touches the id pages, and a filter on the
identifier skips row groups and pages by their statistics.

Chunks between spaces are encoded once per worker: those not seen yet go
through the library, and a document is put together from them (see
ChunkEncoder for why the ids equal those of the whole text).

Defined cases: an added token written out in a text (<|endoftext|>) becomes its
id, as by the library's default, and such a text goes through the library whole;
with ``plain_added=True`` it is plain text, so that no document can forge an end
id; null text is empty (just the end id); rows of equal identifier
are ordered by a hash of their text; a null identifier comes first; an empty
table writes no rows.  Only the identifier and the text are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .chunks import ChunkEncoder
from .common import KEPT, pieces_of, text_or_empty, tidied

BLOCK_BYTES = 2 << 20
STORE_BITS = 21
WRITER = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.columnindex.truncate.length": "64",
    "compression": "zstd",
}


class LibraryEncoder(ChunkEncoder):
    """Chunks through the tokenizers library; texts that hold one of its added
    tokens are one chunk."""

    def __init__(self, json_path: str, pattern: str, bits: int = STORE_BITS, plain_added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(pattern, bits)
        self.tok = Tokenizer.from_file(json_path)
        self.tok.encode_special_tokens = plain_added
        added = [] if plain_added else [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def uncut(self, data: bytes, begin: np.ndarray, size: np.ndarray) -> list[int]:
        if self.added is None:
            return []
        places = [m.start() for m in self.added.finditer(data)]
        filled = np.flatnonzero(size > 0)
        return np.unique(filled[np.searchsorted(begin[filled], places, side="right") - 1]).tolist() if places else []

    def fresh(self, chunks: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for k in range(0, len(chunks), 20_000):
            out += [e.ids for e in self.tok.encode_batch_fast(chunks[k : k + 20_000], add_special_tokens=False)]
        return out


@lru_cache(maxsize=1)
def library_encoder(json_path: str, pattern: str, plain_added: bool) -> LibraryEncoder:
    """One encoder a worker process: its memory serves task after task."""
    return LibraryEncoder(json_path, pattern, plain_added=plain_added)


KEPT["tokens"] = library_encoder.cache_clear


def write_tokens(
    docs: DataFrame,
    path: str,
    json_path: str,
    pattern: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    plain_added: bool = False,
) -> None:
    """Encode every document and write the files in ascending identifier order.

    The range partitioning samples identifiers before anything is encoded, so
    the texts are encoded once.
    """
    src = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    by = [F.col("_id").asc_nulls_first(), F.xxhash64("_text").asc()]
    ordered = src.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = T.StructType(
        [
            T.StructField(id_col, src.schema["_id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("at", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at = None, 0
        for batch in batches:
            coder = coder or library_encoder(json_path, pattern, plain_added)
            for i, j in pieces_of(batch, 1, BLOCK_BYTES):
                ids, sizes = coder.encode(batch.column(1).slice(i, j - i), end_id)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(at + ends[:-1]), listed],
                    [id_col, "n_tokens", "at", "ids"],
                )
                at += int(ends[-1])

    ordered.mapInArrow(tidied(run, "tokens"), schema).write.options(**WRITER).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The token files, or some of their columns; filters on the identifier
    reach the row groups and page indexes."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def document_starts(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, file of every document, from metadata columns only.

    A file's base is the sum over the files before it: one row per file goes
    through a single ordered window, and rows get their base by a join on the
    file name.
    """
    rows = spark.read.parquet(path).select(
        F.col(id_col), "n_tokens", "at", F.col("_metadata.file_path").alias("_file")
    )
    return rows.join(file_bases(rows, id_col), "_file").select(
        id_col, (F.col("_base") + F.col("at")).alias("start"), "n_tokens", F.col("_file").alias("file")
    )


def file_bases(rows: DataFrame, id_col: str) -> DataFrame:
    files = rows.groupBy("_file").agg(
        F.min(F.struct(F.col(id_col), F.col("_file"))).alias("_first"), F.sum("n_tokens").alias("_sum")
    )
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("_file", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_base"))


def checked_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Read the files back: id, start, n_tokens and the CRC-32 of the ids."""
    rows = spark.read.parquet(path).select(
        F.col(id_col), "n_tokens", "at", "ids", F.col("_metadata.file_path").alias("_file")
    )
    schema = T.StructType(
        [
            rows.schema[id_col],
            T.StructField("at", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("_file", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends = np.asarray(lists.offsets)
            raw = memoryview(np.asarray(lists.values).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array(sums, pa.int64()),
                    batch.column(4),
                ],
                [id_col, "at", "n_tokens", "ids_crc32", "_file"],
            )

    read = rows.mapInArrow(tidied(run), schema)
    bases = file_bases(
        spark.read.parquet(path).select(F.col(id_col), "n_tokens", F.col("_metadata.file_path").alias("_file")), id_col
    )
    return read.join(bases, "_file").select(
        id_col, (F.col("_base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )

"""Packing: concatenate all documents' ids and cut the stream into windows of equal length.

Pass one encodes every document and writes its ids with their place inside the task's stream.
The tasks' totals (one row for each task) give global offsets by a prefix sum; pass two cuts each
document at the window borders. A document that crosses a border gives one record on either side.

Null text counts as empty and gives one piece, the end id. A text of any length is encoded whole. Repeated rows are packed each on its own. An
empty table gives no pieces. Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteledger.llm.pretokens import encoder
from siteledger.llm.shared import cut

TOKENS = "part int, doc_id long, part_start long, doc_tokens long, ids binary"


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with end_id after each document's."""
    return np.insert(ids, np.cumsum(counts), end_id).astype("<u4"), counts + 1


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, doc_id, part_start, doc_tokens, ids (little-endian unsigned 32-bit); part is the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                piece = batch.slice(k, 512)
                ids, n = with_end(*enc.encode(piece.column(1).to_pylist()), end_id)
                after = np.cumsum(n)
                borders = np.concatenate([[0], after]) * 4
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(borders.astype("<i8")), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), piece.column(0), pa.array(at + after - n), pa.array(n), blobs.cast(pa.binary())], names=["part", "doc_id", "part_start", "doc_tokens", "ids"])
                at += int(after[-1])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, TOKENS)


def starts_of(totals: DataFrame, key: str, total: str) -> DataFrame:
    """Prefix sums of one row for each part: key, before (total of all parts with a smaller key)."""
    before = F.sum(total).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(key, F.coalesce(before, F.lit(0)).alias("before"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, padded_to, ids.

    Sequences are gapless from offset 0 and all but the last are full. padded_to is the window,
    except for a last sequence whose length is a power of two, which needs no padding.
    """
    tokens = cut(tokenised(docs, tokenizer, end_id, id_col, text_col), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # one row for each task of the first pass, far below the size of a broadcast's limit
    starts = F.broadcast(starts_of(totals, "part", "total"))
    size = totals.agg(F.sum("total")).first()[0] or 0
    last, rest = divmod(size, window)
    padded = rest if rest and rest & (rest - 1) == 0 else window
    at = (F.col("before") + F.col("part_start")).alias("at")
    placed = tokens.join(starts, "part").select("doc_id", "doc_tokens", "ids", at)

    def piece(w):
        start = F.greatest(w * window - F.col("at"), F.lit(0))
        stop = F.least((w + 1) * window - F.col("at"), F.col("doc_tokens"))
        return F.struct(
            start.alias("start"), (stop - start).alias("length"), w.alias("sequence_id"), (F.col("at") + start - w * window).alias("offset"),
            F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int")).alias("ids"),
        )

    first, final = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("doc_tokens") - 1) / window)
    pieces = placed.select("doc_id", "doc_tokens", F.inline(F.transform(F.sequence(first, final), piece)))
    ends = F.when(F.col("sequence_id") == last, F.lit(padded)).otherwise(F.lit(window)).cast("long")
    return pieces.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", ends.alias("padded_to"), "ids")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to")

"""Packing by shortest-pack-first over the histogram of lengths.

A document's ids are cut into full sequences and one rest. The lengths 1..size are placed
longest first, by their counts alone: each goes to the pack with the most room (the
shortest pack) or starts a new one, which updates counts of packing patterns. Patterns are
then joined back to the pieces by rank within a length: the k-th piece of a length takes
the k-th place for that length. Every piece is packed once and whole, so the gaps that the
histogram leaves stay as padding.

Null and empty texts are one piece, their end id. Rows are packed one by one, so repeated
rows (and ids) each get their own pieces; ties of length are broken by doc_id, start and
checksum. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import written
from .tokens import Encoder

SIZE = 1024
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def shortest_pack_first(hist: np.ndarray, size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packing patterns for hist[length] pieces of each length up to size."""
    packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(room: int, count: int, lengths: tuple[int, ...]) -> None:
        (packs.setdefault(room, []) if room else done).append((count, lengths))

    for length in range(min(size, len(hist) - 1), 0, -1):
        left = int(hist[length])
        while left:
            room = max(packs, default=0)
            if room < length:
                put(size - length, left, (length,))
                break
            count, lengths = packs[room].pop()
            if not packs[room]:
                del packs[room]
            used = min(count, left)
            if count > used:
                put(room, count - used, lengths)
            put(room - length, used, (*lengths, length))
            left -= used
    return done + [x for room in sorted(packs) for x in packs[room]]


def padding(patterns: list[tuple[int, tuple[int, ...]]], size: int) -> int:
    """Padded ids; a sequence whose length is a power of two needs none."""
    used = [(c, sum(ls)) for c, ls in patterns]
    return sum(c * (size - u) for c, u in used if u & (u - 1))


def places(patterns: list[tuple[int, tuple[int, ...]]], size: int) -> dict[str, np.ndarray]:
    """The places for each length: those of ranks first, first + 1, ... are at `offset` of
    sequences sequence, sequence + 1, ... Sorted by length and first rank."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            first = taken.get(length, 0)
            taken[length] = first + count
            rows.append((length, first, base, offset))
            offset += length
        base += count
    cols = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "sequence", "offset"), cols)) | {"sequences": np.int64(base)}


def pieces(docs: DataFrame, tokenizer: str, end: int = 0, size: int = SIZE) -> DataFrame:
    """The pieces of every text: full sequences, and its rest."""

    def run(batches):
        encoder = Encoder.of(tokenizer, end)
        for batch in batches:
            for lo, hi, data, off in tx.blocks(batch.column(1)):
                ids, at = encoder.block(data, off)
                total = np.diff(at)
                n = -(-total // size)
                doc = np.repeat(np.arange(hi - lo), n)
                start = tx.ranges(np.zeros_like(n), n) * size
                length = np.minimum(size, total[doc] - start)
                where = at[:-1][doc] + start
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(where, where + length)]
                cols = [batch.column(0).take(pa.array(doc + lo)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens) with sequence_id and offset.

    cut should be a stored table: it is read for the histogram, for the range bounds and
    counts of ranks, and for the result. At most `size` histogram rows and one row for each
    task reach the driver.
    """
    spark = cut.sparkSession
    hist = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        hist[r["length"]] = r["n"]
    table = places(shortest_pack_first(hist, size), size)
    below = np.cumsum(hist) - hist  # pieces of lesser lengths
    ranked = written(cut.repartitionByRange("length", "doc_id", "start", "ids_crc32").sortWithinPartitions("length", "doc_id", "start", "ids_crc32").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "packing-pieces")
    counts = sorted((r["_part"], r["n"]) for r in ranked.groupBy("_part").agg(F.count("*").alias("n")).collect())
    parts = np.array([p for p, _ in counts], np.int64)
    before = np.cumsum([0, *[n for _, n in counts]])[:-1]
    key = table["length"] << 40 | table["first"]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column(2).to_numpy()
            rank = before[np.searchsorted(parts, b.column(5).to_numpy())] + b.column(6).to_numpy() - below[length]
            at = np.searchsorted(key, length << 40 | rank, side="right") - 1
            sequence = table["sequence"][at] + rank - table["first"][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(table["offset"][at])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 0, size: int = SIZE) -> DataFrame:
    return pack(written(pieces(docs, tokenizer, end, size), "packing-cut"), size)

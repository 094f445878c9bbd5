"""Writing a table's token ids to seekable files in id order, and reading them back.

Texts are encoded first and stored; what is sorted and sent are their ids. Null texts are
empty (their end id alone); long texts are taken whole. Null ids come first and are given back
as null. Rows that repeat an id all stay, in the order of the input's partitions; they may fill
several files, so that an id that much of the table has is no single task's. Only doc_id and
text are read, so other columns, whatever their names, play no part. An empty table makes no
file. The files stay in the shared folder; a task that runs again replaces its file.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import fresh, local_path, written
from .tokens import NULL_ID, Encoder, Reader, Writer


def encode(docs: DataFrame, tokenizer: str, end: int = 0, width: int = 2) -> list[dict]:
    """Files of (doc_id, text) in ascending doc_id order; their paths with counts and first places.

    One row per file reaches the driver. width: bytes of an id.
    """
    folder = local_path(fresh(docs.sparkSession, "tokens"))

    def ids_of(batches):
        encoder = Encoder.of(tokenizer, end)
        for batch in batches:
            for lo, hi, data, off in tx.blocks(batch.column(1)):
                ids, at = encoder.block(data, off)
                if len(ids) and int(ids.max()) >> 8 * width:
                    raise ValueError(f"an id does not fit {width} bytes")
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at * width), pa.py_buffer(ids.astype(f"<u{width}"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), raw.cast(pa.binary())], names=["doc_id", "ids"])

    def write(batches):
        out, path = None, f"{folder}/part-{TaskContext.get().partitionId():06d}.zst"
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).fill_null(NULL_ID).to_pylist(), batch.column(1)):
                if out is None:
                    os.makedirs(folder, exist_ok=True)
                    out = Writer(path, width)
                out.add(doc_id, np.frombuffer(ids.as_buffer(), f"<u{width}"))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([out.count]), pa.array([out.total])], names=["path", "n_docs", "n_tokens"])

    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(ids_of, "doc_id long, ids binary")
    rows = written(coded.withColumn("tie", F.monotonically_increasing_id()), "tokens-ids")
    made = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids").mapInArrow(write, "path string, n_docs long, n_tokens long").collect()
    files = sorted((r.asDict() for r in made), key=lambda r: r["path"])
    start = 0
    for f in files:
        f["start"] = start
        start += f["n_tokens"]
    return files


def read(spark, files: list[dict]) -> DataFrame:
    """A row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def rows(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(path)
                for k in range(len(reader.frames)):
                    docs = reader.frame(k)
                    n = np.array([len(ids) for _, ids in docs])
                    starts = start + np.cumsum(n) - n
                    start += int(n.sum())
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in docs]
                    doc_ids = [None if d == NULL_ID else d for d, _ in docs]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                reader.close()

    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(f["path"], f["start"]) for f in files], "path string, start long")
    return listed.repartitionByRange(len(files), "path").mapInArrow(rows, schema)

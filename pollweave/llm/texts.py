"""Helpers that the text operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sizing import remember

# Texts of about this many bytes are worked on at once inside a task; a longer text is a block alone.
BLOCK_BYTES = 2_000_000
# Bytes of rows that are handed to a Python worker at once: JVM and worker both hold them, the worker two such batches.
BATCH_BYTES = 2 * BLOCK_BYTES
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def blocks(batch: pa.RecordBatch, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into row blocks of bounded text size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for row, size in enumerate(sizes):
        if row > start and held + size > block_bytes:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text counts as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def identified(docs: DataFrame, id_column: str, text_column: str, *more: Column) -> DataFrame:
    """Columns ``doc_id``, ``text`` and ``text_hash`` alone, whatever else the input holds.

    A document is one (doc_id, text): rows that repeat both are one document, rows
    that share only the id are different ones.
    """
    text = F.col(text_column)
    return docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), *more)


def mapped(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` by code of this package, which the Python workers are told where to find.

    Batches are bounded by ``BATCH_BYTES`` unless the session sets another bound, and a worker gives free memory
    back after a task, because it is kept for the tasks of other stages.
    """
    if frame.sparkSession.conf.get(_BATCH_SETTING, None) is None:
        frame.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    root, known = str(Path(__file__).resolve().parents[2]), frame.sparkSession.sparkContext.environment
    paths = known.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return frame.mapInArrow(freed, schema)


def per_text(
    docs: DataFrame,
    work: Callable[[list[bytes]], dict[str, list]],
    fields: list[tuple[str, T.DataType]],
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Run ``work`` over blocks of whole texts; one result row per input row, beside ``keep``."""
    kept = [T.StructField(name, docs.schema[name].dataType) for name in keep]
    schema = T.StructType(kept + [T.StructField(name, kind) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text, block_bytes):
                found = work(as_bytes(block.column(text)))
                yield pa.RecordBatch.from_pydict(
                    {name: block.column(name) for name in keep} | {name: found[name] for name, _ in fields},
                    schema=_arrow(schema),
                )

    return mapped(docs.select(*dict.fromkeys((*keep, text))), run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def arrow_schema(schema: T.StructType | str) -> pa.Schema:
    return _arrow(schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema))


def work_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local session may do without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="pollweave-llm-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: lineage ends there."""
    path = f"{work_folder(frame.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    remember(path)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def sha(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)

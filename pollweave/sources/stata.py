"""Fixed-width binary survey files (Stata formats 114 and 115), read by byte ranges.

A header tells the width of a record and where the records start, so every split is a run of whole records
that its task reads by itself. The value labels stand behind the records.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import share_code

SPLIT_BYTES = 64_000_000
BATCH_ROWS = 50_000
# Fixed values of the format: type codes with their numpy types, and the first value of each type that stands for a missing one.
NUMBERS = {251: "i1", 252: "i2", 253: "i4", 254: "f4", 255: "f8"}
FIRST_MISSING = {251: 101, 252: 32741, 253: 2147483621, 254: 2.0**127, 255: 2.0**1023}
SPARK_TYPES = {251: T.IntegerType(), 252: T.IntegerType(), 253: T.IntegerType(), 254: T.DoubleType(), 255: T.DoubleType()}
LONGEST_TEXT = 244
HEAD = "BBBBHI81s18s"
# Days are counted from this one.
EPOCH_DAYS = 3653  # between 1960-01-01 and 1970-01-01


@dataclass(frozen=True)
class Layout:
    """What the header of a file says: byte order, rows, and for each column name, type code, whether it is a day, and the name of its labels."""

    order: str
    rows: int
    names: tuple[str, ...]
    codes: tuple[int, ...]
    days: tuple[bool, ...]
    labels: tuple[str, ...]
    start: int

    @property
    def record(self) -> np.dtype:
        return np.dtype([(f"c{n}", f"{self.order}{NUMBERS[code]}" if code in NUMBERS else f"S{code}") for n, code in enumerate(self.codes)])

    @property
    def end(self) -> int:
        return self.start + self.rows * self.record.itemsize

    def spark_type(self, n: int) -> T.DataType:
        if self.codes[n] not in NUMBERS or self.labels[n]:
            return T.StringType()
        return T.DateType() if self.days[n] else SPARK_TYPES[self.codes[n]]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    plain = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(plain)


def _text(raw: bytes, encoding: str) -> str:
    return raw.split(b"\0", 1)[0].decode(encoding)


def read_layout(file: pa.NativeFile, encoding: str) -> Layout:
    """Parse the header, which is as long as the list of columns."""
    first = file.read(2)
    if len(first) < 2 or first[0] not in (114, 115):
        raise ValueError("not a file of format 114 or 115")
    order = ">" if first[1] == 1 else "<"
    fixed = first + file.read(struct.calcsize(order + HEAD) - 2)
    *_, n_columns, rows, _, _ = struct.unpack(order + HEAD, fixed)
    codes = tuple(file.read(n_columns))
    cut = lambda width: [_text(file.read(width), encoding) for _ in range(n_columns)]
    names = tuple(cut(33))
    file.read(2 * (n_columns + 1))
    formats, labels = cut(49), cut(33)
    file.read(81 * n_columns)
    while True:
        kind, length = struct.unpack(order + "BI", file.read(5))
        if kind == 0 and length == 0:
            break
        file.read(length)
    days = tuple(f.startswith(("%d", "%td", "%-d", "%-td")) for f in formats)
    return Layout(order, rows, names, codes, days, tuple(labels), file.tell())


def read_labels(file: pa.NativeFile, layout: Layout, encoding: str) -> dict[str, dict[int, str]]:
    """The value labels behind the records: texts of whole numbers, by the name of the list."""
    found: dict[str, dict[int, str]] = {}
    file.seek(layout.end)
    while len(head := file.read(40)) == 40:
        length, name = struct.unpack(layout.order + "I33s3x", head)
        body = file.read(length)
        n, size = struct.unpack_from(layout.order + "II", body)
        offsets, values = (struct.unpack_from(f"{layout.order}{n}i", body, 8 + 4 * n * k) for k in (0, 1))
        texts = body[8 + 8 * n : 8 + 8 * n + size]
        found[_text(name, encoding)] = {value: _text(texts[at:], encoding) for value, at in zip(values, offsets)}
    return found


def column_of(values: np.ndarray, code: int, day: bool, labels: dict[int, str] | None, encoding: str) -> pa.Array:
    """One column of records as Arrow: missing values are null, labelled numbers are their texts, or digits without one."""
    if code not in NUMBERS:
        return pa.array([_text(raw, encoding) for raw in values.tolist()], pa.string())
    missing = ~(values < FIRST_MISSING[code])
    if labels is not None:
        return pa.array([None if gone else labels.get(value, str(value)) for value, gone in zip(values.tolist(), missing.tolist())], pa.string())
    if day:
        return pa.array(np.where(missing, 0, values).astype(np.int32) - EPOCH_DAYS, pa.int32(), mask=missing).cast(pa.date32())
    return pa.array(values.astype(np.int32 if code in (251, 252, 253) else np.float64), mask=missing)


@dataclass
class Records(InputPartition):
    path: str
    first: int
    rows: int


class RecordReader(DataSourceReader):
    def __init__(self, schema: T.StructType, paths: Sequence[str], columns: Sequence[str], encoding: str, split_bytes: int):
        self.schema, self.paths, self.columns, self.encoding, self.split_bytes = schema, paths, columns, encoding, split_bytes

    def partitions(self) -> list[Records]:
        """Runs of whole records; only the headers are read."""
        parts = []
        for path in self.paths:
            store, plain = _store(path)
            with store.open_input_file(plain) as file:
                layout = read_layout(file, self.encoding)
            step = max(1, self.split_bytes // max(1, layout.record.itemsize))
            parts += [Records(path, at, min(step, layout.rows - at)) for at in range(0, layout.rows, step)]
        return parts

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        store, plain = _store(partition.path)
        with store.open_input_file(plain) as file:
            layout = read_layout(file, self.encoding)
            places = [layout.names.index(name) for name in self.columns]
            labels = read_labels(file, layout, self.encoding) if any(layout.labels[n] for n in places) else {}
            width, done = layout.record.itemsize, 0
            while done < partition.rows:
                rows = min(BATCH_ROWS, partition.rows - done)
                raw = file.read_at(rows * width, layout.start + (partition.first + done) * width)
                if len(raw) < rows * width:
                    raise ValueError(f"{partition.path} ends within its records")
                held = np.frombuffer(raw, layout.record)
                arrays = [
                    column_of(held[f"c{n}"], layout.codes[n], layout.days[n], labels.get(layout.labels[n], {}) if layout.labels[n] else None, self.encoding)
                    for n in places
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=list(self.columns))
                done += rows


class RecordSource(DataSource):
    """``spark.read.format("pollweave_records")``; options ``columns`` (separated by commas), ``encoding`` and ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "pollweave_records"

    @property
    def encoding(self) -> str:
        return self.options.get("encoding", "latin-1")

    def paths(self) -> list[str]:
        path = self.options["path"]
        store, plain = _store(path)
        if store.get_file_info(plain).type == fs.FileType.File:
            return [path]
        found = sorted(info.path for info in store.get_file_info(fs.FileSelector(plain)) if info.is_file and info.path.endswith(".dta"))
        if not found:
            raise ValueError(f"no .dta file in {path}")
        return [path[: len(path) - len(plain)] + one if path.endswith(plain) else one for one in found]

    def layout(self) -> Layout:
        store, plain = _store(self.paths()[0])
        with store.open_input_file(plain) as file:
            return read_layout(file, self.encoding)

    def columns(self, layout: Layout) -> list[str]:
        wanted = self.options.get("columns")
        return list(layout.names) if wanted is None else [name.strip() for name in wanted.split(",")]

    def schema(self) -> T.StructType:
        layout = self.layout()
        return T.StructType([T.StructField(name, layout.spark_type(layout.names.index(name))) for name in self.columns(layout)])

    def reader(self, schema: T.StructType) -> RecordReader:
        return RecordReader(schema, self.paths(), schema.names, self.encoding, int(self.options.get("splitbytes", SPLIT_BYTES)))


def read_dta(spark: SparkSession, path: str, columns: Sequence[str] | None = None, encoding: str = "latin-1", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A file, or all ``.dta`` files of a folder with one list of columns; only ``columns`` are converted.

    Missing values of all kinds are NULL, days become dates, and numbers with value labels become their labels.
    """
    share_code(spark)
    spark.dataSource.register(RecordSource)
    reader = spark.read.format("pollweave_records").option("encoding", encoding).option("splitBytes", split_bytes)
    return (reader if columns is None else reader.option("columns", ",".join(columns))).load(path)


# --- writing


def dta_bytes(batch: pa.RecordBatch, encoding: str = "latin-1") -> bytes:
    """A whole file in format 115, little-endian; 64-bit numbers and floats become doubles, texts have at most ``LONGEST_TEXT`` bytes."""
    codes, formats, columns = [], [], []
    for column in batch.columns:
        kind, gone = column.type, np.asarray(column.is_null())
        if pa.types.is_string(kind):
            texts = [(value or "").encode(encoding) for value in column.to_pylist()]
            width = max(1, max(map(len, texts), default=1))
            if width > LONGEST_TEXT:
                raise ValueError(f"a text of {width} bytes does not fit")
            codes.append(width), formats.append(f"%{width}s"), columns.append(np.array(texts, f"S{width}"))
            continue
        if pa.types.is_date32(kind):
            code, form, values = 253, "%td", column.cast(pa.int32()).fill_null(0).to_numpy(zero_copy_only=False) + EPOCH_DAYS
        elif pa.types.is_int32(kind) or pa.types.is_int16(kind) or pa.types.is_int8(kind):
            code, form, values = 253, "%12.0g", column.cast(pa.int32()).fill_null(0).to_numpy(zero_copy_only=False)
        else:
            code, form, values = 255, "%10.0g", column.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
        codes.append(code), formats.append(form), columns.append(np.where(gone, FIRST_MISSING[code], values))
    n, names = batch.num_columns, batch.schema.names
    cells = lambda texts, width: b"".join(text.encode(encoding)[: width - 1].ljust(width, b"\0") for text in texts)
    head = struct.pack("<" + HEAD, 115, 2, 1, 0, n, batch.num_rows, b"", b"") + bytes(codes) + cells(names, 33)
    head += bytes(2 * (n + 1)) + cells(formats, 49) + cells([""] * n, 33) + cells([""] * n, 81) + bytes(5)
    records = np.zeros(batch.num_rows, Layout("<", batch.num_rows, tuple(names), tuple(codes), (False,) * n, ("",) * n, 0).record)
    for k, values in enumerate(columns):
        records[f"c{k}"] = values
    return head + records.tobytes()


def save_dta(df: DataFrame, folder: str) -> int:
    """Write a file for every batch of rows into ``folder`` and return the number of rows; a NULL text becomes an empty one.

    A repeated task writes the same file names again, so no row is stored twice.
    """
    share_code(df.sparkSession)
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        for k, batch in enumerate(batches):
            with store.open_output_stream(f"{root}/{run}-{TaskContext.get().partitionId():06d}-{k:06d}.dta") as out:
                out.write(dta_bytes(batch))
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return df.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

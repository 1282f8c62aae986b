"""WARC archives with a two-level capture index.

Pages are written as gzip members of WARC files, payloads that occur again as
revisits. The index holds one line for each capture, sorted by the reversed host, path and id, in
parts by range. A part is a file of compressed blocks of lines with a sparse directory, the first
line of every block, at its end. A lookup goes to the parts that can hold it, finds
the block by binary search in the directory, reads and opens that block alone, and finds
the lines by binary search in it; they name the byte ranges of the records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import struct
import uuid
import zlib
from base64 import b32encode
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import attach, remember
from .texts import arrow_schema, mapped, stored, work_folder

FILE_BYTES = 1_000_000_000  # a WARC file that reaches this size is closed
BLOCK_LINES = 3_000  # captures in a block of the index
READ_BYTES = 4_000_000  # records that lie close together are fetched at once up to this size
READ_GAP = 64_000  # bytes between two records that are rather read than skipped
ROWS_AT_ONCE = 5_000
# The ends of a part are compared on so many characters, which bounds what travels with the tasks.
BOUND_CHARS = 200
LAST = "\U0010ffff"
DATE = "1970-01-01T00:00:00Z"
NO_ID = "-" * 20

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UNSAFE = re.compile("[\x00-\x20\x7f]")
TRAILER = "<QQ"

CAPTURES = "entry string, file string, offset long, length long"
PARTS = "part string, low string, high string, n_blocks long, n_captures long"


@dataclass(frozen=True)
class Archive:
    """A folder of WARC files and index parts; ``captures`` and ``parts`` are stored tables."""

    folder: str
    captures: DataFrame
    parts: DataFrame


def _plain(url: str) -> str:
    return UNSAFE.sub(lambda found: f"%{ord(found.group()):02X}", url)


def capture_key(url: str | None) -> str:
    """Reversed host, ``)``, and the rest of the URL, so that the captures of a domain stand together; without ``://`` the host is empty."""
    scheme, mark, rest = (url or "").partition("://")
    host = re.match("[^/?#]*", rest).group()
    return _plain(",".join(reversed(host.translate(LOWER).split("."))) + ")" + (rest[len(host) :] if mark else scheme))


def entry_of(url: str | None, page_id: int | None) -> str:
    """The sorted part of an index line: key, blank, id in twenty digits (dashes for none)."""
    return f"{capture_key(url)} {NO_ID if page_id is None else format(page_id + 2**63, '020d')}"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it; plain paths and ``file:`` are local."""
    plain = re.sub("^file:/+", "/", folder)
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(plain)


# --- records


def digest_of(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _headed(fields: Iterable[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in fields if value is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, original: int | None, date: str = DATE) -> bytes:
    """A response record, or with ``original`` a revisit of that page's record, which has the same payload."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = original is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _plain(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", _record_id(original, digest) if revisit else None),
        ("Page-ID", page_id),
        ("Refers-To-Page-ID", original),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _headed(fields, http if revisit else http + payload)


def parse(raw: bytes) -> dict:
    """The fields of a record as written by ``record``; the payload's digest is taken anew and compared."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    held = dict(line.split(": ", 1) for line in lines)
    if version != "WARC/1.1" or len(rest) != int(held["Content-Length"]) + 4:
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    n_bytes = int(re.search(rb"\r\nContent-Length: (\d+)", http).group(1))
    digest = held["WARC-Payload-Digest"].removeprefix("sha1:")
    response = held["WARC-Type"] == "response"
    if response and (len(payload) != n_bytes or digest_of(payload) != digest):
        raise ValueError(f"payload of {held['WARC-Record-ID']} differs from its digest")
    number = lambda name: int(held[name]) if name in held else None
    return {
        "page_id": number("Page-ID"),
        "url": held.get("WARC-Target-URI"),
        "payload_bytes": n_bytes,
        "payload_digest": digest,
        "record_type": held["WARC-Type"],
        "refers_to": number("Refers-To-Page-ID"),
        "payload": payload if response else None,
    }


# --- writing


def originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``original`` for each page: the largest id with its payload, null for that page itself and for payloads of one page or below ``least_bytes``.

    Payloads are compared by SHA-256. Only digests that occur several times are joined back, so they alone are measured for a broadcast.
    """
    keyed = pages.withColumn("payload_sha", F.unhex(F.sha2("payload", 256)))
    several = keyed.where(F.octet_length("payload") >= least_bytes).groupBy("payload_sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("largest"))
    joined = attach(keyed, several.where("n > 1").drop("n"), ["payload_sha"])
    return joined.withColumn("original", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))).drop("payload_sha", "largest")


def write_archive(
    pages: DataFrame,
    folder: str | None = None,
    page: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    date: str = DATE,
    file_bytes: int = FILE_BYTES,
    block_lines: int = BLOCK_LINES,
    n_parts: int | None = None,
) -> Archive:
    """Write a record for every row into ``folder`` (a new one in the shared folder if none is given) and index the captures.

    Of rows with equal payloads of at least ``least_bytes`` bytes that with the largest id is a response and the others
    revisit it; rows that repeat the largest id are all responses, and so are rows without ids among themselves. Smaller payloads
    are always responses. A null payload is empty. A null URL is left out of the record and has the key of an empty one.
    Each task writes files of its own names, so an attempt that is lost leaves a file that nothing refers to. An empty
    table makes an archive without parts.
    """
    spark = pages.sparkSession
    if folder is None:
        folder = f"{work_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
        remember(folder)
    given = pages.select(
        F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")
    )
    arrow = arrow_schema(CAPTURES)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(f"{root}/warc", recursive=True)
        out, name, at = None, "", 0
        rows: list[tuple] = []

        def add(raw: bytes) -> int:
            press = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = press.compress(raw) + press.flush()
            out.write(member)
            return len(member)

        try:
            for batch in batches:
                for page_id, target, body, original in zip(*(column.to_pylist() for column in batch.columns)):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name = f"warc/{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
                        at = add(_headed(info, b"software: pollweave\r\nformat: WARC File Format 1.1\r\n"))
                    size = add(record(page_id, target, body, original, date))
                    rows.append((entry_of(target, page_id), name, at, size))
                    at += size
                    if len(rows) >= ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=arrow)
                        rows.clear()
        finally:
            if out is not None:
                out.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=arrow)

    captures = stored(mapped(originals(given, least_bytes).select("page_id", "url", "payload", "original"), write, CAPTURES), "captures")
    return Archive(folder, captures, write_index(captures, folder, block_lines, n_parts))


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, n_parts: int | None = None) -> DataFrame:
    """Sort the captures into index parts and return the table of parts.

    Parts are cut by (entry, file, offset), which no two captures share, so the captures of one URL may fill several parts.
    Their number is Spark's to choose by size, unless ``n_parts`` is given.
    """
    arrow = arrow_schema(PARTS)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        lines = (line for batch in batches for line in zip(*(column.to_pylist() for column in batch.columns)))
        first = next(lines, None)
        if first is None:
            return
        store.create_dir(f"{root}/index", recursive=True)
        name = f"index/{uuid.uuid4().hex}"
        low, high, at, total, directory, held = first[0], first[0], 0, 0, [], [first]
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:

            def flush() -> None:
                nonlocal at, total
                block = gzip.compress("".join(f"{entry} {file} {offset} {length}\n" for entry, file, offset, length in held).encode(), mtime=0)
                directory.append(f"{held[0][0]} {at} {len(block)}\n")
                out.write(block)
                at += len(block)
                total += len(held)
                held.clear()

            for line in lines:
                if len(held) >= block_lines:
                    flush()
                held.append(line)
                high = line[0]
            flush()
            listing = gzip.compress("".join(directory).encode(), mtime=0)
            out.write(listing + struct.pack(TRAILER, at, len(listing)))
        yield pa.RecordBatch.from_pydict({"part": [name], "low": [low], "high": [high], "n_blocks": [len(directory)], "n_captures": [total]}, schema=arrow)

    order = ["entry", "file", "offset"]
    dealt = captures.repartitionByRange(*order) if n_parts is None else captures.repartitionByRange(n_parts, *order)
    return stored(mapped(dealt.sortWithinPartitions(*order).select(*order, "length"), write, PARTS), "index-parts")


# --- lookup


class _Part:
    """An open index part: its directory, and one block at a time."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        at, length = struct.unpack(TRAILER, self.file.read_at(struct.calcsize(TRAILER), size - struct.calcsize(TRAILER)))
        listed = [line.rsplit(" ", 2) for line in gzip.decompress(self.file.read_at(length, at)).decode().split("\n")[:-1]]
        self.firsts = [first for first, _, _ in listed]
        self.ranges = [(int(at), int(length)) for _, at, length in listed]
        self.block, self.lines = -1, []

    def load(self, block: int) -> list[str]:
        if block != self.block:
            at, length = self.ranges[block]
            self.block, self.lines = block, gzip.decompress(self.file.read_at(length, at)).decode().split("\n")[:-1]
        return self.lines

    def find(self, prefix: str) -> Iterator[str]:
        """The lines that start with ``prefix``, from the first block that can hold one on."""
        for block in range(max(0, bisect_left(self.firsts, prefix) - 1), len(self.firsts)):
            lines = self.load(block)
            for at in range(bisect_left(lines, prefix), len(lines)):
                if not lines[at].startswith(prefix):
                    return
                yield lines[at]


def lookup(archive: Archive, prefixes: DataFrame) -> DataFrame:
    """prefix, entry, file, offset and length of every capture whose index line starts with one of the ``prefix`` values.

    A prefix is an entry (one page), a key with a blank (one URL), or the beginning of a key (a domain, a folder).
    Null prefixes find nothing, repeated ones count once, the empty one finds everything. Each prefix goes to the parts that can hold it; the ends of all
    parts, one row a part and cut to ``BOUND_CHARS`` characters, travel with the tasks.
    """
    ends = sorted(archive.parts.select("part", F.substring("low", 1, BOUND_CHARS).alias("low"), F.substring("high", 1, BOUND_CHARS).alias("high")).collect(), key=lambda row: (row.low, row.high))
    lows, highs, names = [row.low for row in ends], [row.high for row in ends], [row.part for row in ends]
    folder = archive.folder
    route_schema, found_schema = "part string, prefix string", f"prefix string, {CAPTURES}"
    route_arrow, found_arrow = arrow_schema(route_schema), arrow_schema(found_schema)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                pairs = []
                for prefix in batch.column(0).slice(start, ROWS_AT_ONCE).to_pylist():
                    first, end = bisect_left(highs, prefix[:BOUND_CHARS]), bisect_right(lows, (prefix + LAST)[:BOUND_CHARS])
                    pairs += [(name, prefix) for name in names[first:end]]
                yield pa.RecordBatch.from_pydict({"part": [p for p, _ in pairs], "prefix": [p for _, p in pairs]}, schema=route_arrow)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        pairs = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        rows: list[list] = []
        for name, own in groupby(pairs, key=lambda pair: pair[0]):
            part = _Part(store, f"{root}/{name}")
            for _, prefix in own:
                for line in part.find(prefix):
                    entry, file, offset, length = line.rsplit(" ", 3)
                    rows.append([prefix, entry, file, int(offset), int(length)])
                    if len(rows) >= ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=found_arrow)
                        rows = []
            part.file.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=found_arrow)

    wanted = prefixes.select(F.col("prefix").cast("string")).where("prefix IS NOT NULL").distinct()
    routed = mapped(wanted, route, route_schema).repartition(max(1, len(names)), "part").sortWithinPartitions("part", "prefix")
    return mapped(routed, search, found_schema)


def entries(pages: DataFrame, page: str = "page_id", url: str = "url", whole: bool = True) -> DataFrame:
    """A ``prefix`` to look up for every row: its entry, or with ``whole`` off its URL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({"prefix": [entry_of(target, page_id) if whole else f"{capture_key(target)} " for page_id, target in rows]})

    return mapped(pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url")), run, "prefix string")


# --- reading


def _fetched(file: pa.NativeFile, places: list[tuple[int, int]]) -> Iterator[bytes]:
    """The byte ranges of one file, in order; ranges close to each other are read at once."""
    start = 0
    while start < len(places):
        end, low, high = start, places[start][0], sum(places[start])
        while end + 1 < len(places) and places[end + 1][0] - high <= READ_GAP and sum(places[end + 1]) - low <= READ_BYTES:
            end += 1
            high = max(high, sum(places[end]))
        held = file.read_at(high - low, low)
        for offset, length in places[start : end + 1]:
            yield held[offset - low : offset - low + length]
        start = end + 1


def read_records(archive: Archive, captures: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and (if wanted) payload of the captures given by file, offset and length.

    The captures of one file are read in order by one task; a file is bounded by ``file_bytes``. The digest of every response
    is taken from the payload that was read; one that differs from its header raises. A revisit has no payload of its own.
    """
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    arrow, folder = arrow_schema(fields), archive.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            rows = zip(*(column.to_pylist() for column in batch.columns))
            for name, own in groupby(rows, key=lambda row: row[0]):
                found, size = [], 0
                with store.open_input_file(f"{root}/{name}") as file:
                    for raw in _fetched(file, [(offset, length) for _, offset, length in own]):
                        found.append(parse(zlib.decompress(raw, 31)))
                        size += found[-1]["payload_bytes"]
                        if size > READ_BYTES or len(found) >= ROWS_AT_ONCE:
                            yield pa.RecordBatch.from_pydict({field: [one[field] for one in found] for field in arrow.names}, schema=arrow)
                            found, size = [], 0
                yield pa.RecordBatch.from_pydict({field: [one[field] for one in found] for field in arrow.names}, schema=arrow)

    # A task for each file: the places are small, so Spark would merge their partitions, but what they name is not.
    files = max(1, archive.captures.select("file").distinct().count())
    places = captures.select("file", "offset", "length").repartition(files, "file").sortWithinPartitions("file", "offset")
    return mapped(places, run, fields)

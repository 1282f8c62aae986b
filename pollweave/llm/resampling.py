"""Importance resampling towards a target distribution, by bit-sliced counts.

Features of a text are hashed into buckets. The bucket counts of a document are kept as
bit planes: bit b of plane p is bit p of the count of bucket b. The gains of the
buckets, whole numbers, become planes too, those of positive and of negative gains
apart. The sum of count times gain over all buckets is then, for every pair of
planes, the number of bits that both have, times a power of two. The planes are
stored once, so another target is scored without reading a text again.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import in_order, number_rows
from .texts import arrow_schema, as_bytes, blocks, mapped, per_text, stored

BUCKETS = 10_000
LEAST_WORDS = 20  # documents with fewer words are scored but never drawn
DRAW_PERCENT = 10
SEED = 2024
# Words are A-Z, a-z, 0-9 and everything beyond ASCII; A-Z are lower-cased.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()  # bytes.lower() knows ASCII alone
# A text is cut into words by slices of this many bytes.
SLICE_BYTES = 1_000_000
# The buckets of words are remembered by each task up to so many bytes; longer words never.
TABLE_BYTES, TABLE_WORD_BYTES = 16_000_000, 40
# Planes that are taken together, so that they stay in the processor's cache.
PLANES_AT_ONCE = 64
# Rows of one chunk of the ranking, if that takes no more chunks than given.
RANK_ROWS, MOST_CHUNKS = 50_000, 10_000


class _Buckets(dict):
    """The bucket of a feature; short features are remembered while there is room."""

    def __init__(self, buckets: int):
        self.buckets, self.room = buckets, TABLE_BYTES

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if self.room > 0 and len(feature) <= TABLE_WORD_BYTES:
            self.room -= len(feature) + 100
            self[feature] = bucket
        return bucket


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice; no word is cut."""
    plain, at = text.translate(WORD_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def bucket_counts(text: bytes, table: _Buckets, max_run: int) -> tuple[int, np.ndarray]:
    """Words of a text, and how many of its runs of 1 to ``max_run`` words fall into each bucket."""
    n_words, counts, tail = 0, np.zeros(table.buckets, np.int64), []
    for words in _slices(text):
        n_words += len(words)
        features, both = list(words), tail + words
        for size in range(2, max_run + 1):
            first = max(0, len(tail) - size + 1)
            features += [b" ".join(both[i : i + size]) for i in range(first, len(both) - size + 1)]
        counts += np.bincount(np.fromiter(map(table.__getitem__, features), np.int64, len(features)), minlength=table.buckets)
        tail = both[len(both) - max_run + 1 :] if max_run > 1 else []
    return n_words, counts


def planes_of(counts: np.ndarray) -> np.ndarray:
    """Bit planes of counts from 0 on, lowest first; each is a row of 64-bit words."""
    n = int(counts.max(initial=0)).bit_length()
    bits = ((counts >> np.arange(n)[:, None]) & 1).astype(np.uint8)
    padded = np.zeros((n, -(-counts.size // 64) * 64), np.uint8)
    padded[:, : counts.size] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def count_planes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_run: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and ``planes`` for every row, stored in the shared folder.

    A feature is a run of 1 to ``max_run`` consecutive words joined by a blank; its bucket is the unsigned
    CRC-32 of its UTF-8 bytes modulo ``buckets``. A null or empty text has no features and no planes.
    """
    if max_run < 1 or buckets < 1:
        raise ValueError("max_run and buckets start at 1")

    def work(texts: list[bytes]) -> dict[str, list]:
        table = _Buckets(buckets)
        found = {"n_words": [], "n_features": [], "planes": []}
        for text in texts:
            n_words, counts = bucket_counts(text, table, max_run)
            found["n_words"].append(n_words)
            found["n_features"].append(int(counts.sum()))
            found["planes"].append(planes_of(counts).tobytes())
        return found

    fields = [("n_words", T.LongType()), ("n_features", T.LongType()), ("planes", T.BinaryType())]
    given = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return stored(per_text(given, work, fields), "planes")


def _rows(block: pa.RecordBatch, width: int) -> tuple[np.ndarray, list[int]]:
    """The planes of a block one below the other, and how many each document has."""
    held = as_bytes(block.column("planes"))
    return np.frombuffer(b"".join(held), np.uint64).reshape(-1, width), [len(one) // (8 * width) for one in held]


def corpus_counts(planes: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all documents in each bucket: per plane the bits are added up bucket by bucket.

    Every task hands on one number a bucket, Spark adds these up; one number a bucket reaches the driver.
    """
    width = -(-buckets // 64)
    schema = "bucket int, n long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * 64, np.int64)
        for batch in batches:
            for block in blocks(batch, "planes"):
                rows, sizes = _rows(block, width)
                level = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, int)
                for p in np.unique(level):
                    own = rows[level == p]
                    for at in range(0, len(own), PLANES_AT_ONCE):
                        bits = np.unpackbits(own[at : at + PLANES_AT_ONCE].view(np.uint8), axis=1, bitorder="little")
                        total += bits.sum(axis=0, dtype=np.int64) << p
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "n": total[at]}, schema=arrow)

    counts = np.zeros(buckets, object)
    for row in mapped(planes.select("planes"), run, schema).groupBy("bucket").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        counts[row.bucket] = int(row.n)
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed source share) of each bucket."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((int(t) + 1) * (s_all + size)) / float((int(s) + 1) * (t_all + size)))) for s, t in zip(source, target)], np.int64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes of the positive and then of the negative gains, and the signed power of two of each."""
    up, down = planes_of(np.maximum(gain, 0)), planes_of(np.maximum(-gain, 0))
    return np.concatenate([up, down]), np.concatenate([1 << np.arange(len(up)), -(1 << np.arange(len(down)))]).astype(np.int64)


def gain_sums(rows: np.ndarray, sizes: list[int], gain_rows: np.ndarray, powers: np.ndarray) -> list[int]:
    """The exact sum of count times gain of each document."""
    own: list[int] = []
    for at in range(0, len(rows), PLANES_AT_ONCE):
        both = rows[at : at + PLANES_AT_ONCE, None, :] & gain_rows[None, :, :]
        own += (np.bitwise_count(both).sum(axis=2, dtype=np.int64) @ powers).tolist()
    sums, start = [], 0
    for n in sizes:
        sums.append(sum(value << p for p, value in enumerate(own[start : start + n])))
        start += n
    return sums


def noise(id_text: str, seed: int) -> int:
    """floor of a thousand standard Gumbel deviates, from the digest of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{id_text}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(planes: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document.

    ``weight`` is the floored mean gain of a document's features, 0 without any; ``score`` adds noise that depends
    on the id alone. A null id has the noise of the empty id.
    """
    gain_rows, powers = gain_planes(gain)
    width = -(-len(gain) // 64)
    schema = f"doc_id {planes.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "planes"):
                sums = gain_sums(*_rows(block, width), gain_rows, powers)
                weights = [total // n if n else 0 for total, n in zip(sums, block.column("n_features").to_pylist())]
                scores = [weight + noise(id_text, seed) for weight, id_text in zip(weights, block.column("id_text").to_pylist())]
                kept = {name: block.column(name) for name in ("doc_id", "n_words", "n_features")}
                yield pa.RecordBatch.from_pydict(kept | {"weight": weights, "score": scores}, schema=arrow)

    return mapped(planes.withColumn("id_text", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), run, schema)


def draw(scored: DataFrame, percent: int = DRAW_PERCENT, least_words: int = LEAST_WORDS, rank_rows: int = RANK_ROWS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3, ... for the drawn documents from the highest score down, else null.

    Of the N documents with ``least_words`` words, floor(percent * N / 100) are drawn. Ties go to the smaller id, null last; of
    repeated ids those with fewer features, then with fewer words, come first. The ranking is cut into ordered chunks, none of which holds all rows.
    """
    scored = stored(scored, "scores")
    able = scored.where(F.col("n_words") >= least_words).withColumn("_down", -F.col("score"))
    n = able.count()
    per_task = 4 * max(rank_rows, -(-n // MOST_CHUNKS))
    ranked = number_rows(in_order(able, (), ("_down", "doc_id", "n_features", "n_words"), per_task, (n, n)), "rank").drop("_down")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_text: str = "text",
    max_run: int = 1,
    buckets: int = BUCKETS,
    percent: int = DRAW_PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``, drawn to resemble the texts of ``target``.

    Every row counts, repeated ones as often as they occur. An empty target or an empty corpus has no features; the
    smoothing then gives all its buckets equal shares. Other columns play no part.
    """
    planes = count_planes(docs, id_column, text_column, max_run, buckets)
    wanted = count_planes(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text")), max_run=max_run, buckets=buckets)
    gain = gains(corpus_counts(planes, buckets), corpus_counts(wanted, buckets))
    return draw(score(planes, gain, seed), percent, least_words)

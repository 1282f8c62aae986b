"""Benchmark passages in training documents, by a positional inverted index.

The index is kept in shards, each over some documents: for every term the sorted
places where it stands in the shard. It holds the terms of the
benchmark; no other term can be asked for. A window of the benchmark is found by
taking the list of its rarest term, shifting it to where the window would
start, and intersecting it with the shifted lists of the other terms in order of rarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import as_bytes, arrow_schema, blocks, identified, mapped, stored

WINDOW = 13
RARE = 3  # terms of an item that a proximity match needs
REACH = 40  # words within which they have to stand
# Words of the benchmark that are looked up in one pass; a larger benchmark is taken in several blocks of items.
BLOCK_WORDS = 2_000_000
# Candidates that are intersected at once inside a task.
MOST_CANDIDATES = 2_000_000

_LETTERS = bytes(byte if chr(byte).isdigit() or chr(byte).islower() or byte > 127 else 32 for byte in range(128)) + bytes(range(128, 256))
FOLD = bytes(byte + 32 if 65 <= byte <= 90 else _LETTERS[byte] for byte in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and characters beyond ASCII."""
    return text.translate(FOLD).split()


class Numbers(dict):
    """Numbers of the benchmark's terms; -1 for any other word."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Windows:
    """The windows of a block of items, as places in the items' joined terms."""

    items: list[str]
    terms: np.ndarray  # term numbers of all items, one behind the other
    first: np.ndarray  # where each window starts in ``terms``
    item: np.ndarray  # whose window it is
    offset: np.ndarray  # where it starts in its item
    length: np.ndarray
    rarity: np.ndarray  # places within the window, rarest term first; unused ones are 0

    def by_rarity(self, frequency: np.ndarray) -> Windows:
        """Order the terms of each window by how often the training documents hold them."""
        width = self.rarity.shape[1]
        inside = np.arange(width)[None, :] < self.length[:, None]
        at = np.where(inside, self.first[:, None] + np.arange(width)[None, :], 0)
        weight = np.where(inside, frequency[self.terms[at]], np.iinfo(np.int64).max)
        self.rarity = np.argsort(weight, axis=1, kind="stable")
        return self


def windows_of(items: list[tuple[str, bytes]], width: int) -> tuple[Numbers, Windows]:
    """Terms and windows of items; one with fewer words than ``width`` is a window of its own, one without words none."""
    numbers, terms, first, item, offset, length = Numbers(), [], [], [], [], []
    for n, (_, text) in enumerate(items):
        words = words_of(text)
        own, start = min(width, len(words)), len(terms)
        for place in range(len(words) - own + 1 if words else 0):
            first.append(start + place)
            item.append(n)
            offset.append(place)
            length.append(own)
        for word in words:
            terms.append(numbers.setdefault(word, len(numbers)))
    ints = lambda values: np.array(values, np.int64)
    rarity = np.zeros((len(first), width), np.int64)
    return numbers, Windows([name for name, _ in items], ints(terms), ints(first), ints(item), ints(offset), ints(length), rarity)


def build_index(docs: DataFrame, numbers: Numbers) -> DataFrame:
    """A row per shard: its documents (id, text hash, words), and the postings of each term in it.

    ``terms``, ``list_ends`` and ``places`` are one list: the places of ``terms[k]`` end
    before ``list_ends[k]``. A place counts the words of the shard's documents, one behind the other.
    """
    known = docs.sparkSession.sparkContext.broadcast(numbers)  # terms of one block of the benchmark: at most BLOCK_WORDS
    document = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("text_hash", "long").add("n_words", "long")
    schema = T.StructType().add("docs", T.ArrayType(document))
    for name in ("terms", "list_ends", "places"):
        schema.add(name, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            for block in blocks(batch, "text"):
                words = [words_of(text) for text in as_bytes(block.column("text"))]
                counts = list(map(len, words))
                found = np.fromiter(map(known.value.__getitem__, chain.from_iterable(words)), np.int32, sum(counts))
                places = np.flatnonzero(found >= 0).astype(np.int32)
                order = np.argsort(found[places], kind="stable")
                terms, starts = np.unique(found[places][order], return_index=True)
                own = pa.StructArray.from_arrays(
                    [block.column("doc_id"), block.column("text_hash"), pa.array(counts, pa.int64())], fields=list(target.field("docs").type.value_type)
                )
                one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(kind)
                lists = [pa.array(x.astype(np.int32)) for x in (terms, np.append(starts[1:], len(places)) if len(terms) else terms, places[order])]
                arrays = [one(own, target.field("docs").type)] + [one(x, target.field(n).type) for n, x in zip(("terms", "list_ends", "places"), lists, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return mapped(docs.select("doc_id", "text_hash", "text"), run, schema)


def term_frequency(index: DataFrame, size: int) -> np.ndarray:
    """How often all documents hold each of the ``size`` terms."""
    lists = index.select(
        F.explode(F.arrays_zip("terms", F.expr("transform(list_ends, (e, k) -> e - IF(k = 0, 0, list_ends[k - 1]))").alias("n"))).alias("one")
    )
    found = np.zeros(size, np.int64)
    for term, n in lists.groupBy("one.terms").agg(F.sum("one.n")).collect():  # a row per benchmark term
        found[term] = n
    return found


class Shard:
    """The lists of one shard, and lookups in them."""

    def __init__(self, counts: np.ndarray, terms: np.ndarray, ends: np.ndarray, places: np.ndarray, size: int):
        self.bounds = np.concatenate(([0], np.cumsum(counts)))
        self.total = int(self.bounds[-1])
        self.places = places.astype(np.int64)
        self.start, self.n = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.start[terms] = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        self.n[terms] = ends - self.start[terms]
        # One sorted list for all terms: looking up term and place is one binary search.
        self.keys = np.repeat(terms.astype(np.int64), self.n[terms]) * (self.total + 1) + self.places

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, "right") - 1

    def holds(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = terms * (self.total + 1) + places
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted

    def exact(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every place where a window stands, within one document."""
        rarest = windows.rarity[:, 0]
        lists = windows.terms[windows.first + rarest] if len(rarest) else rarest
        sizes = self.n[lists]
        ends, found = np.cumsum(sizes), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        low = 0
        while low < len(sizes):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + MOST_CANDIDATES, "right")))
            window = np.repeat(np.arange(low, high), sizes[low:high])
            within = np.arange(len(window)) - np.repeat(ends[low:high] - sizes[low:high] - before, sizes[low:high])
            place = self.places[self.start[lists[window]] + within]
            start = place - rarest[window]
            doc = self.doc_of(place)
            fits = (start >= self.bounds[doc]) & (start + windows.length[window] <= self.bounds[doc + 1])
            window, start = window[fits], start[fits]
            for rank in range(1, windows.rarity.shape[1]):
                if not len(window):
                    break
                step = windows.rarity[window, rank]
                over = windows.length[window] <= rank
                same = over | self.holds(windows.terms[windows.first[window] + np.where(over, 0, step)], start + step)
                window, start = window[same], start[same]
            found.append((window, start))
            low = high
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def near(self, terms: np.ndarray, reach: int) -> set[int]:
        """Documents where all the terms, the rarest first, stand within ``reach`` words of a place of the rarest."""
        if not self.n[terms].all():
            return set()
        one = lambda term: self.places[self.start[term] : self.start[term] + self.n[term]]
        at = one(terms[0])
        for term in terms[1:]:
            own, doc = one(term), self.doc_of(at)
            right = np.searchsorted(own, at)
            close = np.zeros(len(at), bool)
            for other in (own[np.minimum(right, len(own) - 1)], own[np.maximum(right - 1, 0)]):
                close |= (np.abs(other - at) <= reach) & (self.doc_of(other) == doc)
            at = at[close]
        return set(self.doc_of(at).tolist())


def _joined(shard: Shard, windows: Windows, window: np.ndarray, start: np.ndarray) -> dict[int, list[dict]]:
    """Matched windows that go on in both texts, as one span each, by document."""
    doc, item = shard.doc_of(start), windows.item[window]
    order = np.lexsort((start, start - windows.offset[window], item, doc))
    doc, item, start, window = doc[order], item[order], start[order], window[order]
    slope = start - windows.offset[window]
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(slope) != 0) | (np.diff(start) != 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(start)) - 1 if len(heads) else heads
    spans: dict[int, list[dict]] = {}
    for head, tail in zip(heads.tolist(), tails.tolist(), strict=True):
        d = int(doc[head])
        spans.setdefault(d, []).append(
            {
                "item_id": windows.items[int(item[head])],
                "item_start": int(windows.offset[window[head]]),
                "start": int(start[head] - shard.bounds[d]),
                "length": int(start[tail] + windows.length[window[tail]] - start[head]),
            }
        )
    return spans


SPAN = T.StructType().add("item_id", "string").add("item_start", "long").add("start", "long").add("length", "long")


def look_up(index: DataFrame, windows: Windows, size: int, rare: int = RARE, reach: int = REACH) -> DataFrame:
    """doc_id, text_hash, n_words, matches (exact spans) and near (items whose rarest terms stand close) per document."""
    document = index.schema["docs"].dataType.elementType
    schema = T.StructType([*document.fields, T.StructField("matches", T.ArrayType(SPAN)), T.StructField("near", T.ArrayType(T.StringType()))])
    asked = index.sparkSession.sparkContext.broadcast((windows, _rarest(windows, rare)))  # one block of the benchmark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, rarest = asked.value
        target = arrow_schema(schema)
        for batch in batches:
            for n in range(batch.num_rows):
                own = batch.column("docs")[n].values
                lists = [batch.column(name)[n].values.to_numpy() for name in ("terms", "list_ends", "places")]
                shard = Shard(own.field("n_words").to_numpy(), *lists, size)
                spans = _joined(shard, windows, *shard.exact(windows)) if len(shard.keys) else {}
                near: dict[int, list[str]] = {}
                for item, terms in rarest:
                    for d in shard.near(terms, reach):
                        near.setdefault(d, []).append(windows.items[item])
                arrays = [own.field(k) for k in range(len(document.fields))]
                arrays.append(pa.array([spans.get(d, []) for d in range(len(own))], target.field("matches").type))
                arrays.append(pa.array([near.get(d, []) for d in range(len(own))], target.field("near").type))
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target, strict=True)], schema=target)

    return mapped(index, run, schema)


def _rarest(windows: Windows, rare: int) -> list[tuple[int, np.ndarray]]:
    """The rarest different terms of each item, from its windows' orders."""
    best: dict[int, dict[int, int]] = {}
    for w in range(len(windows.first)):
        own = best.setdefault(int(windows.item[w]), {})
        for rank in range(min(rare, int(windows.length[w]))):
            term = int(windows.terms[windows.first[w] + windows.rarity[w, rank]])
            own[term] = min(own.get(term, rank), rank)
    return [(item, np.array(sorted(own, key=lambda t: (own[t], t))[:rare])) for item, own in best.items()]


def covered(spans: Column) -> Column:
    """Words inside any of the spans."""
    step = F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["length"]).alias("end")))),
        F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("end")),
        lambda held, s: F.struct(
            (held["words"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], held["end"]))).alias("words"),
            F.greatest(held["end"], s["end"]).alias("end"),
        ),
    )
    return step["words"]


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rare: int = RARE,
    reach: int = REACH,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """A row per input row: doc_id, text_hash, n_words, matches and near.

    ``matches`` are exact: item, start in it, start in the document, length, in words; ``near`` lists the items
    whose ``rare`` rarest terms all stand within ``reach`` words of the rarest. A null text
    has no words; neither has one without letters and digits. Items with one id count as one, a
    null item id as the empty one. An empty benchmark matches nothing. Rows of documents are looked up alone,
    so repeated rows and null ids give a row each.
    """
    narrow = identified(docs, id_column, text_column)
    asked = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    # An upper bound of the words: no word is shorter than a byte with its gap.
    bound = asked.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    n_blocks = max(1, -(-int(bound) // block_words))
    found = None
    for n in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == n) if n_blocks > 1 else asked
        items = sorted((row.item_id, row.text.encode()) for row in own.distinct().collect())  # bounded by block_words
        numbers, windows = windows_of(items, window)
        index = stored(build_index(narrow, numbers), "postings")
        block = look_up(index, windows.by_rarity(term_frequency(index, len(numbers))), len(numbers), rare, reach)
        found = block if found is None else found.unionByName(block)
    if n_blocks == 1:
        return found
    # Of repeated rows each block has as many: number them, so that they stay apart.
    merged = found.groupBy("doc_id", "text_hash", "n_words").agg(
        F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
        (F.count("*") / n_blocks).cast("int").alias("copies"),
    )
    return merged.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def contamination(found: DataFrame, share: int = 20) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated beside ``doc_id`` and ``n_words``: a 1/``share`` of the words hit, at least."""
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        "doc_id",
        "n_words",
        covered(F.col("matches")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        F.size("near").cast("long").alias("n_near_items"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def without_contaminated(docs: DataFrame, found: DataFrame, share: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The input's rows without the contaminated documents; repeated rows go or stay together."""
    hit = covered(F.col("matches"))
    bad = found.where((hit > 0) & (share * hit >= F.col("n_words"))).select("doc_id", "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text_column)).alias("text_hash"))
    same = F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("r.text_hash") == F.col("b.text_hash"))
    return rows.alias("r").join(bad.alias("b"), same, "left_anti").select("row.*")

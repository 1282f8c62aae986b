"""Similarity join on word n-grams: MinHash bands find candidates, full n-gram sets decide.

Texts with one n-gram set are one node. Nodes that agree in a band are candidates. A bucket
of few nodes gives their pairs; the nodes of a large bucket are compared in blocks
inside tasks, which give counts of links and edges that keep what belongs together
together, never the pairs themselves. Nothing is dropped in either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .texts import arrow_schema, as_bytes, blocks, identified, mapped, stored

WORDS = 5
THRESHOLD = Fraction(4, 5)
RECALL = 0.9999
MOST_HASHES = 96
# Nodes of a bucket whose pairs are listed; a larger bucket is compared in blocks.
SMALL_BUCKET = 16
# N-grams of a large bucket that one side of a block comparison holds.
CHUNK_GRAMS = 1_500_000

DOC = ["doc_id", "text_hash"]
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def bands_for(threshold: float, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have if pairs at the threshold are to meet with that probability."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = 1 if threshold >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - float(threshold) ** rows))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("this recall needs more hashes")
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def gram_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams, lower-cased; a text of fewer words is one n-gram of its own."""
    known: dict[str, int] = {}
    steps = np.resize(_STEPS, words) * (np.arange(words, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    out = []
    for text in texts:
        own = text.decode("utf-8", "replace").lower().split()
        for word in set(own).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.array(list(map(known.__getitem__, own)), np.uint64)
        n = len(hashes) - words + 1
        if not len(hashes):
            out.append(hashes)
        elif n < 1:
            out.append(_mixed(np.array([xxhash.xxh3_64_intdigest(" ".join(own), seed=len(own))], np.uint64)))
        else:
            total = np.zeros(n, np.uint64)
            for k in range(words):
                total += _mixed(hashes[k : k + n] + np.uint64(k)) * steps[k]
            out.append(np.unique(_mixed(total)))
    return out


def signatures(docs: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, n_grams, set_id (digest of the n-gram set) and a hash per band, for ``docs`` as ``identified`` gives them."""
    schema = T.StructType([docs.schema["doc_id"], docs.schema["text_hash"]]).add("n_grams", "long").add("set_id", "binary").add("bands", T.ArrayType(T.LongType()))
    seeds = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            for block in blocks(batch, "text"):
                sets = gram_sets(as_bytes(block.column("text")), words)
                sizes = np.array(list(map(len, sets)))
                full = np.flatnonzero(sizes)
                own = np.zeros((len(sets), bands), np.uint64)
                if len(full):
                    grams = np.concatenate([sets[k] for k in full])
                    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    for band in range(bands):
                        held = np.full(len(full), np.uint64(band + 1))
                        for row in range(rows):
                            least = np.minimum.reduceat(_shuffled(grams, seeds[band * rows + row]), starts)
                            held = _mixed(held * np.uint64(0x9E3779B97F4A7C15) + least)
                        own[full, band] = held
                hashes = [pa.array(own[k].view(np.int64)) if sizes[k] else pa.array([], pa.int64()) for k in range(len(sets))]
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"),
                        block.column("text_hash"),
                        pa.array(sizes, pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None for grams in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(list(map(len, hashes))))), pa.int32()), pa.concat_arrays([pa.array([], pa.int64()), *hashes])).cast(
                            target.field("bands").type
                        ),
                    ],
                    schema=target,
                )

    return mapped(docs, run, schema)


def _shuffled(grams: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = (grams ^ seed) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """set_id and grams (sorted 64-bit hashes, as bytes) of the nodes' first documents."""
    joined = docs.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash")))
    schema = T.StructType().add("set_id", "binary").add("grams", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                sets = [grams.tobytes() for grams in gram_sets(as_bytes(block.column("text")), words)]
                yield pa.RecordBatch.from_arrays([block.column("set_id"), pa.array(sets, pa.binary())], schema=arrow_schema(schema))

    return mapped(joined.select("d.text", "w.set_id"), run, schema).dropDuplicates(["set_id"])


def _verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose full n-gram sets are similar enough."""
    both = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("grams").alias("a_grams")), "a")
    both = both.join(sets.select(F.col("set_id").alias("b"), F.col("grams").alias("b_grams")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a_grams"), batch.column("b_grams"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * threshold.denominator >= threshold.numerator * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return mapped(both.select("a", "b", "a_grams", "b_grams"), run, "a binary, b binary")


class _Block:
    """Some nodes of a large bucket: their sets, and the bands they share with others."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("set_id").to_pylist()
        self.sets = [np.frombuffer(value.as_buffer(), np.uint64) for value in table.column("grams")]
        self.sizes = np.array(list(map(len, self.sets)), np.int64)
        self.copies = table.column("copies").to_numpy()
        self.keys = np.array(table.column("keys").to_pylist(), np.int64)
        self.hot = np.array(table.column("hot").to_pylist(), bool)

    def cuts(self, most_rows: int = 128, most_grams: int = 40_000) -> list[tuple[int, int]]:
        out, start, held = [], 0, 0
        for row, size in enumerate(self.sizes.tolist()):
            if row > start and (row - start >= most_rows or held + size > most_grams):
                out.append((start, row))
                start, held = row, 0
            held += size
        return [*out, (start, len(self.sizes))]

    def matrix(self, start: int, end: int, columns: np.ndarray) -> np.ndarray:
        """Which of the sorted ``columns`` each row's set holds."""
        out = np.zeros((end - start, len(columns)), np.float32)
        for row in range(start, end):
            at = np.searchsorted(columns, self.sets[row])
            at[at == len(columns)] = 0
            out[row - start, at[columns[at] == self.sets[row]]] = 1
        return out


def block_links(left: _Block, right: _Block | None, band: int, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
    """Links between two blocks of a bucket, or within one: per node the documents and nodes linked, and a spanning set of edges.

    A pair counts in the first large bucket that both nodes share, and not at all here if they share a small one.
    """
    other = right or left
    offset = len(left.ids) if right else 0
    n = len(left.ids) + (len(right.ids) if right else 0)
    docs, nodes, labels, edges = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), []
    for a, b in left.cuts():
        columns, rows = None, None
        for c, d in other.cuts():
            if right is None and d <= a:
                continue
            open_ = np.ones((b - a, d - c), bool)
            for k in range(left.keys.shape[1]):
                if k == band:
                    continue
                same = (left.keys[a:b, None, k] == other.keys[None, c:d, k]) & (left.keys[a:b, None, k] != 0)
                open_ &= ~(same & ~left.hot[a:b, None, k] if k > band else same)
            if right is None:
                open_ &= np.arange(c, d)[None, :] > np.arange(a, b)[:, None]
            both = left.sizes[a:b, None] + other.sizes[None, c:d]
            least = np.minimum(left.sizes[a:b, None], other.sizes[None, c:d])
            p, q = threshold.numerator, threshold.denominator
            open_ &= least * q >= p * (both - least)
            if not open_.any():
                continue
            if columns is None:
                columns = np.unique(np.concatenate(left.sets[a:b]))
                rows = left.matrix(a, b, columns)
            common = np.rint(rows @ other.matrix(c, d, columns).T).astype(np.int64)
            linked = open_ & (common * q >= p * (both - common))
            docs[a:b] += linked @ other.copies[c:d]
            nodes[a:b] += linked.sum(axis=1)
            docs[offset + c : offset + d] += left.copies[a:b] @ linked
            nodes[offset + c : offset + d] += linked.sum(axis=0)
            for row in np.flatnonzero(linked.any(axis=1)):
                partners = np.flatnonzero(linked[row]) + offset + c
                for label, first in zip(*np.unique(labels[partners], return_index=True), strict=True):
                    if label != labels[a + row]:
                        labels[labels == label] = labels[a + row]
                        edges.append((left.ids[a + row], other.ids[partners[first] - offset]))
    return docs, nodes, edges


def _blocked(hot: DataFrame, sets: DataFrame, threshold: Fraction, chunk_grams: int) -> DataFrame:
    """Links of large buckets: rows (a, null, documents, nodes) with counts, and rows (a, b, 0, 0) with edges."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("bucket_grams") / chunk_grams)).cast("int")
    own = F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int")
    placed = hot.withColumn("chunks", chunks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rows = placed.join(sets, "set_id").select("key", "band", "i", "j", "own", "set_id", "copies", "keys", "hot", "grams")
    schema = T._parse_datatype_string("a binary, b binary, docs long, nodes long")

    def solve(table: pa.Table) -> pa.Table:
        i, j, band = (table.column(name)[0].as_py() for name in ("i", "j", "band"))
        parts = [table.filter(pa.array(table.column("own").to_numpy() == side)) for side in dict.fromkeys((i, j))]
        if not all(part.num_rows for part in parts):
            return arrow_schema(schema).empty_table()
        sides = [_Block(part) for part in parts]
        docs, nodes, edges = block_links(sides[0], sides[1] if j != i else None, band, threshold)
        ids = [x for side in sides for x in side.ids]
        keep = np.flatnonzero(nodes)
        ends = lambda k: [edge[k] for edge in edges]
        none, zeros = [None] * len(keep), [0] * len(edges)
        return pa.table(
            {"a": [ids[k] for k in keep] + ends(0), "b": none + ends(1), "docs": docs[keep].tolist() + zeros, "nodes": nodes[keep].tolist() + zeros}, schema=arrow_schema(schema)
        )

    return rows.groupBy("key", "i", "j").applyInArrow(solve, schema)


def similar(
    docs: DataFrame,
    threshold: Fraction = THRESHOLD,
    words: int = WORDS,
    recall: float = RECALL,
    id_column: str = "doc_id",
    text_column: str = "text",
    small_bucket: int = SMALL_BUCKET,
    chunk_grams: int = CHUNK_GRAMS,
) -> DataFrame:
    """doc_id, text_hash, class_doc, class_hash, copy_id, n_links, n_texts and n_grams for every input row.

    Two documents are linked if the Jaccard similarity of their sets of word ``words``-grams, lower-cased and split at white space, is
    ``threshold`` or more; a candidate pair is always decided on the full sets, and a pair at the threshold is a
    candidate with probability ``recall``. ``class_doc`` and ``class_hash`` name the first document, by id and then text hash (null
    first), of all that links connect; ``copy_id`` is the id of the first one with the same n-gram set. ``n_links`` counts the other documents linked
    to this one, copies among them, ``n_texts`` the other n-gram sets.

    A text with fewer words than ``words`` is one n-gram, so it is linked to its copies alone. A null text, or one without words, is
    linked to nothing. Rows that repeat id and text are copies. Other columns are not read.
    """
    narrow = identified(docs, id_column, text_column)
    bands, rows = bands_for(threshold, recall)
    signed = stored(signatures(narrow, bands, rows, words), "signatures")
    full = signed.where("n_grams > 0")
    nodes = full.groupBy("set_id", "n_grams").agg(F.min(F.struct(*DOC)).alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = stored(nodes, "nodes")

    banded = nodes.select("set_id", "n_grams", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_grams").alias("bucket_grams")).where("n > 1")
    shared = stored(banded.join(buckets, "key"), "buckets")

    wanted = nodes.join(shared.select("set_id").distinct(), "set_id", "left_semi").select("set_id", "first.*")
    sets = stored(_sets(narrow, wanted, words), "sets")

    small = shared.where(F.col("n") <= small_bucket).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("set_id", "n_grams"))).alias("own"))
    p, q = threshold.numerator, threshold.denominator
    pairs = (
        small.select("own", F.posexplode("own").alias("at", "one"))
        .select("one", F.explode(F.expr("slice(own, at + 2, size(own))")).alias("two"))
        # The smaller set is at best a part of the larger.
        .where(f"least(one.n_grams, two.n_grams) * {q} >= greatest(one.n_grams, two.n_grams) * {p}")
        .select(F.col("one.set_id").alias("a"), F.col("two.set_id").alias("b"))
        .distinct()
    )
    links = stored(_verified(pairs, sets, threshold), "pairs")

    is_hot = F.col("n") > small_bucket
    per_node = shared.groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("key", is_hot.alias("hot"))))).alias("in_band"), F.max(is_hot).alias("any_hot")).where("any_hot")
    own = F.sequence(F.lit(0), F.lit(bands - 1))
    vectors = per_node.join(nodes.select("set_id", "copies"), "set_id").select(
        "set_id",
        "copies",
        F.transform(own, lambda k: F.coalesce(F.try_element_at("in_band", k)["key"], F.lit(0).cast("long"))).alias("keys"),
        F.transform(own, lambda k: F.coalesce(F.try_element_at("in_band", k)["hot"], F.lit(False))).alias("hot"),
    )
    hot = shared.where(is_hot).select("key", "band", "set_id", "bucket_grams").join(vectors, "set_id")
    blocked = stored(_blocked(hot, sets, threshold, chunk_grams), "blocks")

    copies = nodes.select("set_id", "copies")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = ends.join(copies, ends["b"] == copies["set_id"]).groupBy("a").agg(F.sum("copies").alias("docs"), F.count("*").alias("nodes"))
    counts = counts.unionByName(blocked.where("b IS NULL").select("a", "docs", "nodes")).groupBy("a").agg(F.sum("docs").alias("docs"), F.sum("nodes").alias("nodes"))

    roots = components(links.unionByName(blocked.where("b IS NOT NULL").select("a", "b")))
    placed = nodes.join(roots, nodes["set_id"] == roots["node"], "left").select("set_id", "first", "copies", F.coalesce("root", "set_id").alias("root"))
    classes = placed.groupBy("root").agg(F.min("first").alias("class"))
    known = placed.join(classes, "root").join(counts, placed["set_id"] == counts["a"], "left")
    known = known.select("set_id", "class", "first", (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("nodes", F.lit(0)).alias("n_texts"))
    return signed.select(*DOC, "set_id", "n_grams").join(known, "set_id", "left").select(
        *DOC,
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class.doc_id")).alias("class_doc"),
        F.when(F.col("class").isNull(), F.col("text_hash")).otherwise(F.col("class.text_hash")).alias("class_hash"),
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
        "n_grams",
    )


def first_of_class(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The input's rows without those that are not the first of their class; of repeated rows one stays."""
    firsts = found.where(F.col("class_doc").eqNullSafe(F.col("doc_id")) & (F.col("class_hash") == F.col("text_hash"))).select(*DOC).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text_column)).alias("text_hash"))
    kept = rows.alias("r").join(firsts.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.text_hash") == F.col("f.text_hash")), "left_semi")
    return kept.dropDuplicates(DOC).select("row.*")

"""Repeated byte strings across all texts, by a hash-compared sort of sampled suffixes.

Every string of ``length`` bytes holds a shorter gram with the least hash; such grams are
the anchors, and equal strings have theirs at the same place. Anchors are dealt out by the
gram's hash. Where the bytes around an anchor (all that a string through it
can touch) recur as a whole, all of them are repeated. Else the suffixes at the anchors of
a gram are merge-sorted: prefix hashes and a binary search give the common extension of two
suffixes, so a comparison takes logarithmic time. From that order the order of the suffixes
that start one byte further left follows by one stable sort on that byte, and so on;
in each order equal strings are neighbours, and are verified byte by byte.

No byte goes on a hash alone. An order is checked against the bytes before it is used. Surroundings that recur
are compared with those of their first anchor, in stretches as long as the copies; what differs goes
through the sort. A gram with too many anchors for one sort is split by the bytes that equal strings must
share if they start in the first or in the second half of the places left of the gram, as often as needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import arrow_schema, as_bytes, blocks, identified, mapped, stored

LENGTH = 200
GRAM = 50
# Suffixes that are sorted at once, more or less; anchors of one gram stay together up to HOT_GRAM of them,
# beyond that they are split by further bytes.
SORT_ROWS = 6_000
HOT_GRAM = 50_000
# Bytes whose windows are hashed at once.
STRETCH = 500_000
# Copies are compared in pieces of at most so many bytes.
PIECE = 1_024

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
DOC = ["doc_id", "text_hash"]
HEAD = ["head_id", "head_hash"]


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""

    def up(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return up(BASE), up(pow(BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


def _sliding(values: np.ndarray, width: int, better: np.ufunc, worst: int) -> np.ndarray:
    """The best of each ``width`` neighbouring values, two passes whatever the width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, worst, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    front = better.accumulate(table, axis=1).ravel()
    back = better.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return better(back[:n], front[width - 1 : width - 1 + n])


def anchors(text: np.ndarray, bounds: np.ndarray, length: int, gram: int, stretch: int = STRETCH, mask: int = MASK) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in texts that stand one behind the other, and their gram's hashes."""
    width = length - gram + 1
    powers, inverse = _powers(stretch + length + 1)
    doc_end = np.repeat(bounds[1:], np.diff(bounds))
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for low in range(0, len(text) - length + 1, stretch):
        part = text[low : low + stretch + length - 1]
        n = len(part)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64, out=prefix[1:])
        grams = _mixed((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1]) & np.uint64(mask)
        least = _sliding(grams, width, np.minimum, MASK)
        starts = np.arange(low, low + len(least))
        least[starts + length > doc_end[starts]] = 0  # no window reaches over the end of its text
        around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        around[width - 1 : width - 1 + len(least)] = least
        chosen = np.flatnonzero(_sliding(around, width, np.maximum, 0) == grams)
        places.append(chosen + low)
        hashes.append(grams[chosen])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _once_per_text(doc: np.ndarray, around: np.ndarray, gram: np.ndarray, context: Callable[[int], tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Order in which equal anchors of one text follow each other, and where each kind begins in it; ``context`` gives what lies around an anchor."""
    order = np.lexsort((np.arange(len(doc)), around, gram, doc))
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = (np.diff(doc[order]) == 0) & (around[order][1:] == around[order][:-1]) & (gram[order][1:] == gram[order][:-1])
    heads = np.flatnonzero(~same)
    of_head = np.cumsum(~same) - 1
    follow = np.flatnonzero(same)
    firsts = order[heads[of_head[follow]]]
    wrong = [at for at, row, first in zip(follow.tolist(), order[follow].tolist(), firsts.tolist(), strict=True) if context(row) != context(first)]
    if wrong:  # equal hashes of different bytes: every anchor of such a kind has its own row
        same &= ~np.isin(of_head, of_head[wrong])
    return order, np.flatnonzero(~same)


def _anchor_rows(docs: DataFrame, length: int, gram: int, mask: int) -> DataFrame:
    """An anchor per row; those of one text with the same bytes around them, as in a text that repeats one word, share a row."""
    schema = T.StructType(
        [
            T.StructField("gram", T.LongType()),
            T.StructField("around", T.LongType()),
            docs.schema["doc_id"],
            docs.schema["text_hash"],
            T.StructField("place", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("more", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            for block in blocks(batch, "text"):
                texts = as_bytes(block.column("text"))
                sizes = np.array(list(map(len, texts)), np.int64)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                joined = b"".join(texts)
                place, grams = anchors(np.frombuffer(joined, np.uint8), bounds, length, gram, mask=mask)
                doc = np.searchsorted(bounds, place, "right") - 1
                left = np.minimum(place - bounds[doc], length - gram)
                low, high = place - left, np.minimum(place + length, bounds[doc + 1])
                view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
                around = np.array([digest(view[a:b], seed=s) for a, b, s in zip(low.tolist(), high.tolist(), left.tolist(), strict=True)], np.uint64)
                around &= np.uint64(mask)
                order, heads = _once_per_text(doc, around, grams, lambda row, joined=joined, low=low, high=high, left=left: (left[row], joined[low[row] : high[row]]))
                first, rows = order[heads], pa.array(doc[order[heads]])
                # Behind each head stand its further places.
                ends = np.append(heads[1:], len(order))
                lengths = ends - heads - 1
                others = np.delete(order, heads)
                more = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(place[others] - bounds[doc[others]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[first].view(np.int64)),
                        pa.array(around[first].view(np.int64)),
                        block.column("doc_id").take(rows),
                        block.column("text_hash").take(rows),
                        pa.array(place[first] - bounds[doc[first]]),
                        pa.array(sizes[doc[first]]),
                        more.cast(target.field("more").type),
                    ],
                    schema=target,
                )

    return mapped(docs, run, schema)


def _merge_sorted(prefix: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order of the rows by their first ``sizes`` bytes; ``prefix[:, m]`` is the hash of the first m bytes of a row.

    Bottom-up mergesort: of two sorted runs each row's place in the other run is found by binary search, for
    all runs of a level together.
    """
    n, longest = len(sizes), data.shape[1]

    def before(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(x), np.int64), np.minimum(sizes[x], sizes[y])
        most = high.copy()
        while True:  # the longest common prefix, by halving
            open_ = low < high
            if not open_.any():
                break
            middle = (low + high + 1) // 2
            same = prefix[x, middle] == prefix[y, middle]
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        at = np.minimum(low, longest - 1)
        differ = low < most
        by_size = np.where(sizes[x] != sizes[y], sizes[x] < sizes[y], or_equal)
        return np.where(differ, data[x, at] < data[y, at], by_size)

    order, run = np.arange(n), 1
    while run < n:
        index = np.arange(n)
        block = index // (2 * run)
        first = index % (2 * run) < run
        start = block * 2 * run
        other_low = np.where(first, np.minimum(start + run, n), start)
        other_high = np.where(first, np.minimum(start + 2 * run, n), np.minimum(start + run, n))
        low, high = other_low.copy(), other_high.copy()
        while (open_ := low < high).any():
            at = np.flatnonzero(open_)
            middle = (low[at] + high[at]) // 2
            # A row of the first run goes in front of equal rows of the second.
            goes_on = before(order[middle], order[at], ~first[at])
            low[at] = np.where(goes_on, middle + 1, low[at])
            high[at] = np.where(goes_on, high[at], middle)
        own = index - np.where(first, start, np.minimum(start + run, n))
        merged = order.copy()  # hashes that collide may leave places open
        merged[start + own + (low - other_low)] = order
        order, run = merged, 2 * run
    return order


def _in_order(order: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether ``order`` holds every row once, by its bytes."""
    if (np.bincount(order, minlength=len(sizes)) != 1).any():
        return False
    x, y = order[:-1], order[1:]
    differ = (data[x] != data[y]) & (np.arange(data.shape[1]) < np.minimum(sizes[x], sizes[y])[:, None])
    at = differ.argmax(axis=1)
    return bool(np.where(differ.any(axis=1), data[x, at] < data[y, at], sizes[x] <= sizes[y]).all())


def repeated_reach(
    contexts: list[bytes], left: np.ndarray, length: int, gram: int, steps: tuple[int, int] | None = None, mask: int = MASK
) -> tuple[np.ndarray, np.ndarray]:
    """For each context, how far left of its anchor repeated strings start at most and at least; -1 without one.

    ``steps`` limits the search to strings that start at least so many and less than so many bytes left of the anchor;
    all contexts have to reach as far left as the first of them.
    """
    n, wide = len(contexts), length - gram
    first, end = steps or (0, wide + 1)
    right = np.array(list(map(len, contexts)), np.int64) - left
    data = np.zeros((n, wide + length), np.uint8)
    for row, (context, own) in enumerate(zip(contexts, left.tolist(), strict=True)):
        data[row, wide - own : wide - own + len(context)] = np.frombuffer(context, np.uint8)
    base = np.uint64(BASE)
    hashes = np.zeros((n, data.shape[1] + 1), np.uint64)
    for column in range(data.shape[1]):
        hashes[:, column + 1] = hashes[:, column] * base + data[:, column] + np.uint64(1)
    powers = _powers(wide + length + 1)[0]
    origin = wide - first
    prefix = (hashes[:, origin:] - hashes[:, origin : origin + 1] * powers[None, : length + first + 1]) & np.uint64(mask)
    order = _merge_sorted(prefix, data[:, origin:], right + first)
    if not _in_order(order, data[:, origin:], right + first):
        order = np.array(sorted(range(n), key=lambda row: data[row, origin : wide + right[row]].tobytes()), np.int64)
    most, least = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for step in range(first, end):
        if step > first:
            order = order[np.argsort(data[order, wide - step], kind="stable")]
        inside = order[(left[order] >= step) & (right[order] >= length - step)]
        start = wide - step
        window = (hashes[inside, start + length] - hashes[inside, start] * powers[length]) & np.uint64(mask)
        pairs = np.flatnonzero(window[1:] == window[:-1])
        a, b = inside[pairs], inside[pairs + 1]
        same = (data[a, start : start + length] == data[b, start : start + length]).all(axis=1)
        found = np.concatenate((a[same], b[same]))
        least[found] = np.where(least[found] < 0, step, least[found])
        most[found] = step
    return most, least


def _sorted_spans(groups: DataFrame, length: int, gram: int, sort_rows: int, mask: int) -> DataFrame:
    """Spans that the sort finds for anchors that stand alone; of a group the strings that start ``low`` to ``high`` bytes left of the gram."""
    schema = T.StructType([groups.schema["doc_id"], groups.schema["text_hash"]]).add("start", "long").add("end", "long")

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lows, highs = rows.column("low").to_numpy(), rows.column("high").to_numpy()
        for low in np.unique(lows):
            of_low = np.flatnonzero(lows == low)
            part = rows.take(pa.array(of_low))
            steps = int(low), int(highs[of_low[0]])
            most, least = repeated_reach(part.column("context").to_pylist(), part.column("left").to_numpy(), length, gram, steps, mask)
            keep = np.flatnonzero((most >= 0) & part.column("alone").to_numpy(zero_copy_only=False))
            place, picked = part.column("place").to_numpy()[keep], pa.array(keep)
            columns = [part.column(name).take(picked).combine_chunks() for name in DOC]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place - most[keep]), pa.array(place - least[keep] + length)], schema=arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows = pa.concat_tables(held)
            while rows.num_rows >= sort_rows:
                keys = rows.column("group").to_numpy()
                ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
                ends = ends[ends <= max(sort_rows, ends[0])] if len(ends) else ends
                if not len(ends):
                    break
                yield from solve(rows.slice(0, int(ends[-1])))
                rows = rows.slice(int(ends[-1]))
            held = [rows]
        if held and held[0].num_rows:
            yield from solve(held[0])

    return mapped(groups.repartition("group").sortWithinPartitions("group"), run, schema)


def _split(groups: DataFrame, length: int, hot_gram: int) -> DataFrame:
    """Each group in two, for either half of its places, by the bytes that equal strings from these places share."""
    middle = F.expr("(low + high) div 2")
    halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
    rest = [c for c in groups.columns if c not in ("low", "high", "group", "hot")]
    rows = groups.select(*rest, F.explode(halves).alias("half")).select(*rest, "half.low", "half.high")
    rows = rows.where(f"high > low AND left >= low AND length(context) - left >= {length} + 1 - high")
    shared = F.substring("context", F.expr("cast(left - low + 1 AS int)"), F.expr(f"cast({length} + 1 + low - high AS int)"))
    rows = rows.withColumn("group", F.xxhash64("low", shared))
    sizes = rows.groupBy("group").agg(F.count("*").alias("members")).where("members > 1")
    return rows.join(sizes, "group").withColumn("hot", F.col("members") > hot_gram).drop("members")


def _equal_spans(groups: DataFrame, length: int) -> DataFrame:
    """Groups of strings from one place: equal ones are counted by their bytes, apart for each place, as one string may lie left of two anchors."""
    string = F.substring("context", F.expr("cast(left - low + 1 AS int)"), F.lit(length))
    strings = groups.select(*DOC, "alone", "low", (F.col("place") - F.col("low")).alias("start"), string.alias("string"))
    often = strings.groupBy("low", "string").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return strings.where("alone").join(often, ["low", "string"], "left_semi").select(*DOC, "start", (F.col("start") + length).alias("end"))


def _spans_by_sort(contexts: DataFrame, length: int, gram: int, sort_rows: int, hot_gram: int, mask: int) -> DataFrame:
    """Spans of all groups; those with over ``hot_gram`` anchors are split until each half fits or is one place wide."""
    groups = contexts.withColumns({"group": F.col("gram"), "low": F.lit(0).cast("long"), "high": F.lit(length - gram + 1).cast("long")})
    spans = _sorted_spans(groups.where("NOT hot"), length, gram, sort_rows, mask)
    hot = groups.where("hot")
    while not hot.isEmpty():
        parts = stored(_split(hot, length, hot_gram), "parts")
        spans = spans.unionByName(_sorted_spans(parts.where("NOT hot"), length, gram, sort_rows, mask))
        spans = spans.unionByName(_equal_spans(parts.where("hot AND high - low = 1"), length))
        hot = parts.where("hot AND high - low > 1")
    return spans


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, sort_rows: int = SORT_ROWS, hot_gram: int = HOT_GRAM, hash_bits: int = 64
) -> DataFrame:
    """doc_id, text_hash, start, end of byte spans that strings of ``length`` bytes found elsewhere cover; ``docs`` as ``identified`` gives them."""
    if not 0 < gram <= length:
        raise ValueError("a gram has from one byte up to the whole length")
    mask = (1 << hash_bits) - 1
    same = Window.partitionBy("gram", "around")
    # Dealt by the gram alone, which serves both windows.
    marks = _anchor_rows(docs, length, gram, mask).repartition("gram").withColumns(
        {
            "n": F.sum(1 + F.size("more")).over(same),
            "head": F.min(F.struct(*DOC, "place", "size")).over(same),
            "first": F.row_number().over(same.orderBy(*DOC, "place", "size")) == 1,
        }
    )
    of_gram = Window.partitionBy("gram")
    marks = marks.withColumns({"of_gram": F.sum(1 + F.size("more")).over(of_gram), "kinds": F.sum(F.col("first").cast("int")).over(of_gram)})
    marks = stored(marks.where("of_gram > 1").drop("around", "of_gram"), "anchors")
    marks = marks.select("*", F.col("head.doc_id").alias("head_id"), F.col("head.text_hash").alias("head_hash"), (F.col("head.place") - F.col("place")).alias("shift"))
    wide = length - gram
    left, right = F.least(F.lit(wide).cast("long"), F.col("place")), F.least(F.lit(length).cast("long"), F.col("size") - F.col("place"))
    head_left, head_right = (F.least(F.lit(wide).cast("long"), F.col("head.place")), F.least(F.lit(length).cast("long"), F.col("head.size") - F.col("head.place")))
    marks = marks.withColumns({"start": F.col("place") - left, "end": F.col("place") + right, "even": (left == head_left) & (right == head_right)})

    copies = marks.where("n > 1 AND NOT first")
    pieces = _pieces(copies.where("even"))
    wanted = marks.where("first AND kinds > 1").select("gram", *DOC, "place", "start", "end", (F.col("n") == 1).alias("alone"), (F.col("kinds") > hot_gram).alias("hot"))
    heads = pieces.select(*HEAD, "h_start", "h_end").distinct().select(F.col("head_id").alias("doc_id"), F.col("head_hash").alias("text_hash"), "*")
    compared = pieces.drop("shift").unionByName(heads.withColumns({"start": F.col("h_start"), "end": F.col("h_end")}))
    cut = stored(_cut(docs, wanted.unionByName(compared, allowMissingColumns=True)), "contexts")
    contexts = cut.where("gram IS NOT NULL").withColumn("left", F.least(F.lit(wide).cast("long"), F.col("place"))).drop(*HEAD, "h_start", "h_end")
    spans = _spans_by_sort(contexts, length, gram, sort_rows, hot_gram, mask)

    # A stretch of copies is what it seems if its bytes are those of its head.
    differ = cut.where("gram IS NULL").groupBy(*HEAD, "h_start", "h_end").agg(F.count_distinct("context").alias("kinds")).where("kinds > 1").drop("kinds")
    odd = stored(
        pieces.join(differ, _equal(pieces, differ, [*HEAD, "h_start", "h_end"]), "left_semi").select(*DOC, *HEAD, "shift").unionByName(copies.where("NOT even").select(*DOC, *HEAD, "shift")).distinct(),
        "odd",
    )
    whole = marks.where("n > 1")
    if not odd.isEmpty():
        key = [*DOC, *HEAD, "shift"]
        wrong = stored(copies.join(odd, _equal(copies, odd, key), "left_semi"), "wrong")
        good = copies.join(odd, _equal(copies, odd, key), "left_anti")
        backed = good.select(*(F.col(f"head.{name}").alias(name) for name in (*DOC, "place"))).distinct()
        firsts = marks.where("first")
        whole = marks.where("size(more) > 0").unionByName(good).unionByName(firsts.join(backed, _equal(firsts, backed, [*DOC, "place"]), "left_semi"))
        again = wrong.unionByName(firsts.join(wrong.select("gram").distinct(), "gram", "left_semi"))
        sizes = again.groupBy("gram").agg(F.count("*").alias("members"))
        again = again.join(sizes, "gram").select("gram", *DOC, "place", "start", "end", F.lit(True).alias("alone"), (F.col("members") > hot_gram).alias("hot"))
        contexts = stored(_cut(docs, again).withColumn("left", F.least(F.lit(wide).cast("long"), F.col("place"))), "contexts")
        spans = spans.unionByName(_spans_by_sort(contexts, length, gram, sort_rows, hot_gram, mask))
    whole = whole.select(*DOC, "size", F.explode(F.concat(F.array("place"), "more")).alias("place")).select(
        *DOC, F.greatest(F.lit(0).cast("long"), F.col("place") - wide).alias("start"), F.least(F.col("size"), F.col("place") + length).alias("end")
    )
    return whole.unionByName(spans)


def _equal(one: DataFrame, other: DataFrame, names: list[str]) -> Column:
    """Join condition by columns of the same names, null ids being ids."""
    return reduce(lambda x, y: x & y, (one[name].eqNullSafe(other[name]) for name in names))


def _pieces(copies: DataFrame) -> DataFrame:
    """Stretches of copies that lie in step with their head, in pieces: where they start and end in the text and in the head's."""
    run = Window.partitionBy(*DOC, *HEAD, "shift").orderBy("start", "end")
    rows = copies.select(*DOC, *HEAD, "shift", "start", "end").withColumn("new", (F.col("start") > F.lag("end").over(run)).cast("int"))
    rows = rows.withColumn("run", F.coalesce(F.sum("new").over(run.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    runs = rows.groupBy(*DOC, *HEAD, "shift", "run").agg((F.min("start") + F.col("shift")).alias("low"), (F.max("end") + F.col("shift")).alias("high"))
    cuts = runs.select("*", F.explode(F.sequence(F.expr(f"low div {PIECE}"), F.expr(f"(high - 1) div {PIECE}"))).alias("cut"))
    cuts = cuts.withColumns({"h_start": F.greatest("low", F.col("cut") * PIECE), "h_end": F.least("high", (F.col("cut") + 1) * PIECE)})
    return cuts.select(*DOC, *HEAD, "shift", "h_start", "h_end", (F.col("h_start") - F.col("shift")).alias("start"), (F.col("h_end") - F.col("shift")).alias("end"))


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes from ``start`` to ``end`` of each wanted row's text as ``context``, in place of these two columns."""
    own = [c for c in wanted.columns if c not in DOC]
    lists = wanted.groupBy(*DOC).agg(F.collect_list(F.struct(*own)).alias("places"))  # as many as a text has anchors and pieces
    joined = docs.join(lists, _equal(docs, lists, DOC)).select(docs["doc_id"], docs["text_hash"], docs["text"], lists["places"])
    schema = T.StructType([*(wanted.schema[c] for c in wanted.columns if c not in ("start", "end")), T.StructField("context", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            for block in blocks(batch, "text", 500_000):
                rows, picked = [], []
                for row, (text, places) in enumerate(zip(as_bytes(block.column("text")), block.column("places").to_pylist(), strict=True)):
                    for one in places:
                        rows.append(one | {"context": text[one["start"] : one["end"]]})
                        picked.append(row)
                at = pa.array(picked, pa.int64())
                ids = {"doc_id": block.column("doc_id").take(at), "text_hash": block.column("text_hash").take(at)}
                yield pa.RecordBatch.from_arrays([ids[f.name] if f.name in ids else pa.array([r[f.name] for r in rows], f.type) for f in target], schema=target)

    return mapped(joined, run, schema)


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every document: ``spans`` joined and cut out."""
    lists = spans.groupBy(*DOC).agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # as many as a text has anchors
    joined = docs.alias("d").join(lists.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash")), "left")
    joined = joined.select("d.doc_id", "d.text", "s.spans")
    schema = T.StructType([docs.schema["doc_id"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
                for text, spans in zip(as_bytes(block.column("text")), block.column("spans").to_pylist(), strict=True):
                    parts, end, n = [], 0, 0
                    for span in sorted((s["start"], s["end"]) for s in spans or ()):
                        if span[0] > end or not n:
                            parts.append(text[end : span[0]])
                            n += 1
                        end = max(end, span[1])
                    parts.append(text[end:])
                    kept = b"".join(parts)
                    for name, value in (("n_bytes", len(text)), ("n_removed", len(text) - len(kept)), ("n_spans", n), ("kept", kept)):
                        out[name].append(value)
                yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id")} | out, schema=arrow_schema(schema))

    return mapped(joined, run, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text", **bounds: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) for every input row.

    Each byte goes that a string of ``length`` bytes covers which also starts anywhere else, in the same text or
    another; all copies go, the first too. Strings are those of the input, never across
    texts. A null text counts as empty; texts shorter than ``length`` stay. Repeated rows are copies of each
    other. Other columns are not read. An empty table gives an empty result. Hashes that collide cost time
    and change nothing (``hash_bits`` shortens them for tests).
    """
    narrow = identified(docs, id_column, text_column)
    return without_spans(narrow, repeated_spans(narrow, length, gram, **bounds))

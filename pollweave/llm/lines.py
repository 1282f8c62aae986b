"""Repeated runs of lines, found by winnowing; built-in Spark expressions alone.

A window is a shortest run of consecutive lines, from a line on or up to a line, that holds a
least number of words. Of each window the line with the smallest hash is its fingerprint, so
texts that share such a run share a fingerprint. Only windows
whose fingerprint stands in several places go on. They are matched whole, by a digest
of their lines, in place of an extension from the fingerprint line by line; a run
that occurs earlier is deleted, and runs that touch are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .texts import identified, stored

# A repeated run is deleted if it holds so many words.
MIN_WORDS = 50
WORD = r"[^ \t\n\x0B\f\r]+"
DOC = ["doc_id", "text_hash"]
# Lines of a document that are worked on at once; longer documents go through in sections.
SECTION_LINES = 500


def _reach(run: Column, min_words: int) -> Column:
    """How many lines from the front of ``run`` it takes for ``min_words``; null if it has fewer."""
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
    end = F.aggregate(
        run,
        zero,
        lambda held, line: F.when(held["words"] >= min_words, held).otherwise(
            F.struct((held["words"] + line["words"]).alias("words"), (held["lines"] + 1).alias("lines"))
        ),
    )
    return F.when(end["words"] >= min_words, end["lines"])


def _sections(docs: DataFrame, min_words: int, section_lines: int) -> DataFrame:
    """doc_id, text_hash, lines, low, high: the lines with a word, in sections of bounded length.

    ``low`` and ``high`` are the places in ``lines`` of the section's own lines; around them stand as many lines
    of the document as a window that begins or ends in the section can hold.
    """
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, n: F.struct(n.alias("n"), F.md5(line).alias("digest"), F.regexp_count(line, F.lit(WORD)).alias("words"), F.xxhash64(line).alias("hash")),
    )
    # The generator keeps the list from being computed again for each of its sections.
    held = docs.select(*DOC, F.explode(F.array(F.filter(lines, lambda line: line["words"] > 0))).alias("all"))
    size = F.size("all")

    def section(k: Column) -> Column:
        low, high = k * section_lines, F.least((k + 1) * section_lines, size)  # lines before it, and up to its end
        start = F.greatest(low - (min_words - 1), F.lit(0))
        around = F.slice("all", start + 1, F.least(high + min_words - 1, size) - start)
        return F.struct(around.alias("lines"), (low - start + 1).alias("low"), (high - start).alias("high"))

    numbers = F.sequence(F.lit(0), F.floor((size - 1) / section_lines).cast("int"))
    cut = held.select(*DOC, F.explode(F.when(size > 0, F.transform(numbers, section))).alias("s"))
    return cut.select(*DOC, "s.lines", "s.low", "s.high")


def windows(docs: DataFrame, min_words: int = MIN_WORDS, section_lines: int = SECTION_LINES) -> DataFrame:
    """doc_id, text_hash, print, print_at, run, first, last for every window; ``docs`` as ``identified`` gives them.

    Lines without a word are passed over. ``print`` and ``print_at`` are the hash and the line number
    of the fingerprint, ``run`` is a digest of the digests of the window's lines. A window over the border of two
    sections may come twice.
    """
    # A line has a word at least, so a window has at most min_words lines: start and length fit into one number.
    base = min_words + 1

    def ahead(i: Column) -> Column:
        return i.cast("long") * base + _reach(F.slice("lines", i, F.lit(min_words)), min_words)

    def behind(i: Column) -> Column:
        n = _reach(F.reverse(F.slice("lines", F.greatest(i - min_words + 1, F.lit(1)), F.least(i, F.lit(min_words)))), min_words)
        return (i - n + 1).cast("long") * base + n

    places = F.sequence("low", "high")
    spans = F.array_distinct(F.array_compact(F.concat(F.transform(places, ahead), F.transform(places, behind))))

    def own(span: Column) -> Column:
        return F.slice("lines", F.floor(span / base).cast("int"), (span % base).cast("int"))

    cut = _sections(docs, min_words, section_lines).select(*DOC, F.explode(F.transform(spans, own)).alias("own"))
    least = F.array_min(F.transform("own", lambda line: F.struct(line["hash"], (-line["n"]).alias("back"))))
    return cut.select(
        *DOC,
        F.element_at("own", 1)["n"].alias("first"),
        F.element_at("own", -1)["n"].alias("last"),
        F.unhex(F.md5(F.array_join("own.digest", ""))).alias("run"),
        least.alias("least"),
    ).select(*DOC, F.col("least.hash").alias("print"), (-F.col("least.back")).alias("print_at"), "run", "first", "last")


def repeated_prints(found: DataFrame) -> DataFrame:
    """Fingerprints that stand in more than one place."""
    place = F.struct(*DOC, "print_at")
    return found.groupBy("print").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("print")


def later_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, first, last: runs of lines that occur earlier, joined where they touch."""
    found = stored(windows(docs, min_words), "windows")
    matched = stored(found.join(repeated_prints(found), "print", "left_semi"), "line-windows")
    place = F.struct(*DOC, "first")
    first = matched.groupBy("print", "run").agg(F.min(place).alias("origin"), F.max(place).alias("high")).where("origin <> high").drop("high")
    # Stored, so that both sides of the join are plain exchanges, whose skewed partitions Spark splits.
    first = stored(first, "origins")
    later = matched.join(first, ["print", "run"]).where(place > F.col("origin")).select(*DOC, "first", "last").distinct()
    own = Window.partitionBy(*DOC).orderBy("first", "last")
    before = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    parts = later.withColumn("new", F.when(F.col("first") <= before + 1, 0).otherwise(1)).withColumn("part", F.sum("new").over(own))
    return parts.groupBy(*DOC, "part").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("part")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The input's rows and columns with later repeated runs of lines taken out of the text.

    A line goes if it lies in a run of consecutive lines with ``min_words`` words in all whose lines also occur,
    in that order, at an earlier place of the corpus: in a document with a smaller id (null first; of equal ids the
    smaller text hash), or further up in the same one. So the first copy stays whole.
    Lines are compared as they are; lines without a word are passed over, and go if they lie
    inside a shortest such run. ``n_lines`` and ``n_removed`` are added, in place of input columns with these names.

    A null or empty text stays as it is, with 0 lines if null; a text of which all goes is
    empty. Rows that repeat id and text are one document and are treated alike.
    """
    gone = later_runs(identified(docs, id_column, text_column), min_words)
    spans = gone.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))  # as many as a document has runs
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text_column)).alias("text_hash"))
    joined = rows.alias("r").join(spans.alias("s"), F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.text_hash") == F.col("s.text_hash")), "left")
    # Split after the join, once a row.
    joined = joined.select("row", "spans", F.explode(F.array(F.split(F.col(f"row.`{text_column}`"), "\n"))).alias("lines"))

    def between(k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("spans", k - 1)["last"] + 1)
        end = F.when(k == F.size("spans"), F.size("lines")).otherwise(F.get("spans", k)["first"])
        return F.slice("lines", start + 1, end - start)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("spans")), between))
    removed = F.aggregate("spans", F.lit(0), lambda total, s: total + s["last"] - s["first"] + 1)
    text = F.when(F.col("spans").isNull(), F.col(f"row.`{text_column}`")).otherwise(F.array_join(kept, "\n"))
    names = [name for name in docs.columns if name not in ("n_lines", "n_removed")]
    return joined.select(
        *[text.alias(name) if name == text_column else F.col("row").getField(name).alias(name) for name in names],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )

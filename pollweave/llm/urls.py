"""URL filters by a sort-merge range join.

The host is written backwards, label by label, and the path behind it. A URL
stands in that order once for each of its domains, so a rule for a host, all its
subdomains and a path prefix is one interval of keys. Keys are dealt out by range,
each range gets the rules whose intervals reach into it, and a sweep over the sorted
range keeps a stack of the rules that are open: the top is the longest that fits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chat import _batches, _rows
from .texts import arrow_schema, mapped

# Keys in a range, more or less: what one sweep sorts. Ranges are cut at sampled keys.
KEYS_PER_RANGE = 500_000
LEAST_RANGES, LEAST_KEYS = 64, 2_000  # so many ranges, if each gets so many keys
SAMPLE_PER_RANGE = 40
LABEL_END = "\x01"
PATH_START = "\x02"
RULE, PAGE = 0, 1


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(found, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _domain_key(labels: Column, n: Column) -> Column:
    """Key of the domain of the last ``n`` labels: each label with its end mark, from the last one."""
    return F.array_join(F.transform(F.slice(labels, 1, n), lambda label: F.concat(label, F.lit(LABEL_END))), "")


def _backwards(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _cuts(keys: DataFrame, keys_per_range: int) -> list[str]:
    """Sampled keys at which ranges are cut; their number is that of the ranges, not of the rows."""
    total = keys.count()
    ranges = max(-(-total // keys_per_range), min(LEAST_RANGES, total // LEAST_KEYS))
    if ranges < 2:
        return []
    share = min(1.0, 1.2 * SAMPLE_PER_RANGE * ranges / total)
    sample = sorted(row[0] for row in keys.sample(share, seed=7).select("sort_key").collect())
    return sorted({sample[n * len(sample) // ranges] for n in range(1, ranges)} if sample else set())


def apply_rules(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    page: str = "page_id",
    url: str = "url",
    keys_per_range: int = KEYS_PER_RANGE,
) -> DataFrame:
    """A row per input row: page_id, host, path, rule and verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all
    subdomains if the path starts with the rule's; the one with most characters
    of host and path wins, of equal ones that with the longer host. Without one
    the rule is null and the verdict is ``default``. A rule with a null or empty host never fits; a null path is
    an empty one; of rules with one host and path the smallest verdict
    counts. A null URL, or one without ``://``, has empty host and path. Repeated rows and null ids are
    judged alike.

    A host with many pages is cut over ranges, as path and page are part of the order.
    """
    judged = pages.select(F.col(page).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = _backwards(F.col("host"))
    urls = judged.where("host <> ''").select("host", "path").distinct()
    known = rules.where("host IS NOT NULL AND host <> ''").groupBy("host", F.coalesce("path", F.lit("")).alias("path")).agg(F.min("verdict").alias("verdict"))
    # No rule fits a domain with more labels than the deepest rule has.
    deepest = known.agg(F.max(F.size(_backwards(F.col("host"))))).first()[0] or 1
    domains = urls.withColumn("labels", labels).withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest)))))
    keys = domains.select("host", "path", F.concat(_domain_key(F.col("labels"), F.col("n")), F.lit(PATH_START), F.col("path")).alias("key"))
    keys = keys.withColumn("sort_key", F.concat("key", F.lit("\x00"), F.xxhash64("host", "path").cast("string")))
    cuts = _cuts(keys, keys_per_range)
    edges = keys.sparkSession.sparkContext.broadcast(cuts)  # a key for each range

    key_of_rule = F.concat(_domain_key(_backwards(F.col("host")), F.size(_backwards(F.col("host")))), F.lit(PATH_START), F.col("path"))
    events = keys.select(
        F.lit(PAGE).alias("kind"), "key", "sort_key", "host", "path", F.lit(None).cast("string").alias("verdict")
    ).unionByName(known.select(F.lit(RULE).alias("kind"), key_of_rule.alias("key"), key_of_rule.alias("sort_key"), "host", "path", "verdict"))
    placed = T.StructType([T.StructField("range", T.IntegerType()), *events.schema.fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for row in _rows(batches):
                n = bisect_right(edges.value, row["sort_key"])
                yield {"range": n} | row
                # A rule goes to all ranges that begin within its interval, too.
                while row["kind"] == RULE and n < len(edges.value) and edges.value[n].startswith(row["key"]):
                    n += 1
                    yield {"range": n} | row

        yield from _batches(found(), arrow_schema(placed))

    out = T.StructType().add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string").add("chars", "long").add("host_chars", "long")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            stack, current = [], None
            for row in _rows(batches):
                if row["range"] != current:
                    stack, current = [], row["range"]
                while stack and not row["key"].startswith(stack[-1]["key"]):
                    stack.pop()
                if row["kind"] == RULE:
                    stack.append(row)
                elif stack:
                    top = stack[-1]
                    rule = top["host"] + top["path"]
                    yield {"host": row["host"], "path": row["path"], "rule": rule, "verdict": top["verdict"], "chars": len(rule), "host_chars": len(top["host"])}

        yield from _batches(found(), arrow_schema(out))

    dealt = mapped(events, place, placed).repartition("range").sortWithinPartitions("range", "key", "kind")
    fits = mapped(dealt, sweep, out)
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("chars", "host_chars")).alias("best"))
    return judged.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )

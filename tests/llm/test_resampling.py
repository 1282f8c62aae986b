import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pandas.testing import assert_frame_equal

from pollweave.llm import resampling

from .helpers import awkward, frame, pandas_pair


def test_query_agrees_with_sql(spark):
    assert_frame_equal(*pandas_pair(spark, "op13_target_resampling", "doc_id"), check_dtype=False)


def brute(rows, target, max_run, buckets, percent, least_words):
    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        runs = [" ".join(words[i : i + n]) for n in range(1, max_run + 1) for i in range(len(words) - n + 1)]
        return len(words), Counter(zlib.crc32(run.encode()) % buckets for run in runs)

    own = [(doc_id, *features(text)) for doc_id, text in rows]
    s, t = sum((one[2] for one in own), Counter()), sum((features(text)[1] for text in target), Counter())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, n_words, counts in own:
        n = counts.total()
        weight = sum(gain[b] * k for b, k in counts.items()) // n if n else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n_words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((one for one in out if one[1] >= least_words), key=lambda one: (-one[4], one[0] is None, one[0] or 0, one[2], one[1]))
    for place, one in enumerate(able[: percent * len(able) // 100]):
        one[5] = place + 1
    return out


def same(found, wanted):
    assert sorted(map(repr, map(list, found.collect()))) == sorted(map(repr, wanted))


def test_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).select("doc_id", "text").collect()]
    rows += [(100 + k, " ".join(f"w{(k * j) % 50}" for j in range(k))) for k in range(60)]
    target = ["w1 w2 w3 w1 w2", None, "", "THE cat ÄÖÜ 9"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS planes", "2 AS rank", "3 AS n_words").repartition(4)
    for max_run, buckets, percent, least in ((1, 10_000, 10, 20), (3, 100, 50, 1), (2, 64, 100, 5)):
        found = resampling.resample(docs, frame(spark, target), max_run=max_run, buckets=buckets, percent=percent, least_words=least)
        same(found, brute(rows, target, max_run, buckets, percent, least))


def test_runs_over_slices_and_chunked_ranks(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 40)
    text = " ".join(f"word{k % 13}" for k in range(300)).encode()
    table = resampling._Buckets(97)
    n, counts = resampling.bucket_counts(text, table, 3)
    words = text.split()
    want = Counter(zlib.crc32(b" ".join(words[i : i + k])) % 97 for k in (1, 2, 3) for i in range(301 - k))
    assert n == 300 and {b: int(c) for b, c in enumerate(counts) if c} == dict(want)
    scored = spark.range(2000).selectExpr("id AS doc_id", "id % 30 AS n_words", "id % 30 AS n_features", "id % 7 AS weight", "pmod(hash(id), 40)::long AS score").repartition(6)
    rows = [list(r) + [None] for r in scored.collect()]
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(able[: 10 * len(able) // 100]):
        r[5] = k + 1
    for size in (20, 1_000_000):
        same(resampling.draw(scored, rank_rows=size), rows)


def test_planes_hold_counts_and_gains_exactly():
    dice = np.random.default_rng(3)
    counts = dice.integers(0, 2**33, (5, 130)) >> dice.integers(0, 34, (5, 130))
    gain = dice.integers(-9000, 9000, 130)
    rows = [resampling.planes_of(one) for one in counts]
    sums = resampling.gain_sums(np.concatenate(rows), [len(one) for one in rows], *resampling.gain_planes(gain))
    assert sums == [sum(int(a) * int(b) for a, b in zip(one, gain)) for one in counts]
    assert resampling.planes_of(np.zeros(130, np.int64)).size == 0


def test_empty_tables(spark):
    none = frame(spark, [])
    assert resampling.resample(none, none).count() == 0
    row = resampling.resample(frame(spark, ["a b"]), none, least_words=1, percent=100).first()
    assert (row.n_features, row.rank) == (2, 1)

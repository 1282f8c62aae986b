import random
import re
from collections import defaultdict

import pytest
from pandas.testing import assert_frame_equal

from pollweave.llm import decontam

from .helpers import awkward, frame, pandas_pair

ITEMS = "item_id long, text string"


def test_query_agrees_with_sql(spark):
    assert_frame_equal(*pandas_pair(spark, "op6_decontamination", "doc_id"))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, width):
    windows = defaultdict(set)
    for key, text in items:
        own = words(text)
        for k in range(max(1, len(own) - width + 1) if own else 0):
            windows[tuple(own[k : k + width])].add(str(key))
    out = []
    for text in texts:
        own, hit, found = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(own) - size + 1):
                if (keys := windows.get(tuple(own[k : k + size]))) and len(own) >= size:
                    hit |= set(range(k, k + size))
                    found |= keys
        out.append((len(own), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize(("width", "bounds"), [(3, {}), (5, {}), (3, {"block_words": 25})])
def test_windows_against_brute_force(spark, width, bounds):
    pick = random.Random(width)
    texts = [" ".join(pick.choice(["a", "B", "c", "d-e", "é", "f1"]) for _ in range(pick.choice([0, 2, 10, 60]))) for _ in range(40)] + [None]
    items = [(n, " ".join(pick.choice(["a", "b", "c", "D", "e", "é"]) for _ in range(pick.choice([1, 2, 4, 8])))) for n in range(8)] + [(9, None), (10, "..."), (10, "a b c")]
    given, asked = frame(spark, texts), frame(spark, items, ITEMS)
    rows = {r.doc_id: r for r in decontam.matches(given, asked, width, **bounds).selectExpr("*", "array_sort(array_distinct(transform(matches, m -> m.item_id))) AS found").collect()}
    hits = {r.doc_id: r for r in decontam.contamination(decontam.matches(given, asked, width, **bounds)).collect()}
    for n, (size, hit, found) in enumerate(brute(texts, items, width)):
        assert (rows[n].n_words, hits[n].n_hit, rows[n].found) == (size, hit, found), texts[n]


def test_spans_say_where(spark):
    docs = frame(spark, ["x y one two three four z"])
    row = decontam.matches(docs, frame(spark, [(5, "zero one two three four five")], ITEMS), 3).first()
    assert [tuple(m) for m in row.matches] == [("5", 1, 2, 4)]


def test_proximity(spark):
    asked = frame(spark, [(1, "alpha beta gamma")], ITEMS)
    texts = ["gamma x beta y alpha", "gamma " + "x " * 30 + "beta alpha", "alpha beta", "x"]
    rows = {r.doc_id: r for r in decontam.matches(frame(spark, texts), asked, 3, reach=6).collect()}
    assert [list(rows[n].near) for n in range(4)] == [["1"], [], [], []]
    assert all(not rows[n].matches for n in range(4))


def test_awkward_rows(spark):
    asked = frame(spark, [(1, "the cat sat"), (None, "another text"), (None, None)], ITEMS)
    given = awkward(spark)
    found = decontam.matches(given, asked, 3)
    assert found.count() == 11
    assert {(r.doc_id, m.item_id) for r in found.collect() for m in r.matches} == {(1, "1"), (1, "")}
    left = decontam.without_contaminated(given, found)
    assert left.columns == given.columns and left.count() == 9
    empty = spark.createDataFrame([], ITEMS)
    assert decontam.matches(given, empty).selectExpr("sum(size(matches))").first()[0] == 0
    assert decontam.matches(frame(spark, []), asked).count() == 0

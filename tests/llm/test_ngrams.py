import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pandas.testing import assert_frame_equal

from pollweave.llm import ngrams
from pollweave.llm.components import components
from pollweave.llm.queries import QUERIES

from .helpers import FOLDER, awkward, frame, pandas_pair


def brute(rows, size=5, threshold=Fraction(4, 5)):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        grams = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
        sets.append(grams if len(words) >= size else {("short", *words)} if words else set())
    holders, links = defaultdict(list), defaultdict(set)
    for k, own in enumerate(sets):
        for gram in own:
            holders[gram].append(k)
    for k, own in enumerate(sets):
        for j, n in Counter(j for gram in own for j in holders[gram] if j != k).items():
            if n >= threshold * (len(own) + len(sets[j]) - n):
                links[k].add(j)
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[k], *(label[j] for j in links[k])]) for k in range(len(rows))]
    return {key: (rows[label[k]][0], len(links[k]), len(sets[k])) for k, (key, _) in enumerate(rows)}


def near_copies(seed):
    pick = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for _ in range(12):
        base = [pick.choice(words) for _ in range(pick.choice([3, 12, 60, 200]))]
        for _ in range(pick.choice([1, 2, 5, 30])):
            own = list(base)
            for _ in range(pick.choice([0, 0, 1, 2, 4])):
                own[pick.randrange(len(own))] = pick.choice(words)
            rows.append((len(rows), " ".join(own)))
    n = len(rows)
    return [*rows, (n, None), (n + 1, ""), (n + 2, rows[0][1].upper())]


@pytest.mark.parametrize("bounds", [{"small_bucket": 1000}, {"small_bucket": 2}, {"small_bucket": 1, "chunk_grams": 300}])
def test_all_links_between_different_texts(spark, bounds):
    rows = near_copies(3)
    found = {r.doc_id: (r.class_doc, r.n_links, r.n_grams) for r in ngrams.similar(frame(spark, rows), **bounds).collect()}
    assert found == brute(rows)


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    found = {r.doc_id: (r.class_id, r.n_links, r.n_grams) for r in QUERIES["op5_ngram_join"](spark, FOLDER).collect()}
    assert found == brute(docs)


def test_query_agrees_with_sql(spark):
    assert_frame_equal(*pandas_pair(spark, "op5_ngram_join", "doc_id"))


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = ngrams.bands_for(threshold, 0.999, 256)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 256
    assert ngrams.bands_for(Fraction(4, 5)) == (18, 4)
    with pytest.raises(ValueError):
        ngrams.bands_for(0.01, 0.9999, 10)


def test_awkward_rows(spark):
    given = awkward(spark, "n_links")
    found = ngrams.similar(given)
    rows = found.collect()
    assert len(rows) == 11
    assert [(r.class_doc, r.n_links) for r in rows if r.doc_id == 6] == [(6, 1), (6, 1)]
    assert {(r.doc_id, r.class_doc, r.n_links) for r in rows if r.n_grams == 0} == {(2, 2, 0), (3, 3, 0), (4, 4, 0), (None, None, 0)}
    kept = ngrams.first_of_class(given, found)
    assert kept.columns == given.columns and kept.count() == 10
    assert ngrams.similar(frame(spark, [])).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 50), (100, 51), (100, 52), (7, 7), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == dict.fromkeys(range(41), 0) | dict.fromkeys([50, 51, 52, 100], 50)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

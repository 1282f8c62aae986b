import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from pollweave.llm import suffix
from pollweave.llm.queries import QUERIES

from .helpers import FOLDER, awkward, frame


def brute(texts, length):
    places = defaultdict(list)
    for d, text in enumerate(texts):
        for p in range(len(text) - length + 1):
            places[text[p : p + length]].append((d, p))
    gone = [bytearray(len(text)) for text in texts]
    for own in places.values():
        for d, p in own if len(own) > 1 else ():
            gone[d][p : p + length] = b"\1" * length
    spans = [sum(1 for i, g in enumerate(own) if g and (not i or not own[i - 1])) for own in gone]
    return [(len(t), sum(g), n, bytes(b for b, x in zip(t, g, strict=True) if not x)) for t, g, n in zip(texts, gone, spans, strict=True)]


def mixed_texts(seed, letters):
    pick = random.Random(seed)
    some = lambda n: "".join(pick.choice(letters) for _ in range(n))
    texts = [some(pick.choice([0, 5, 30, 80, 200])) for _ in range(50)]
    for _ in range(25):
        one = pick.choice(texts)
        at = pick.randrange(max(1, len(one)))
        texts.append(some(7) + one[at : at + pick.randrange(60)] + some(9))
    return [*texts, "a" * 50, "a" * 31, texts[3], texts[3], None, ""]


@pytest.mark.parametrize(
    ("letters", "length", "gram", "bounds"),
    [("abcdefg", 8, 3, {}), ("abé", 12, 12, {}), ("abcdefg", 20, 6, {"sort_rows": 10}), ("abé", 9, 1, {"sort_rows": 10}), ("abcd", 8, 3, {"hot_gram": 1})]
    + [("abcdefg", 20, 6, {"hot_gram": 1}), ("abé", 12, 12, {"hash_bits": 8}), ("abcdefg", 20, 6, {"hash_bits": 8, "hot_gram": 3}), ("abcd", 8, 3, {"hash_bits": 8, "sort_rows": 10})],
)
def test_against_every_string(spark, letters, length, gram, bounds):
    texts = mixed_texts(length, letters)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(frame(spark, texts), length, gram, **bounds).collect()}
    want = brute([(text or "").encode() for text in texts], length)
    assert [found[n] for n in range(len(texts))] == want


def test_query(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    want = brute([text.encode() for _, text in docs], 200)
    found = {r.doc_id: r for r in QUERIES["op7_suffix_dedup"](spark, FOLDER).collect()}
    for (key, _), (size, removed, spans, kept) in zip(docs, want, strict=True):
        row = found[key]
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (size, removed, spans, sha256(kept).hexdigest())


def test_merge_sort_is_a_sort():
    pick = np.random.default_rng(4)
    sizes = pick.integers(0, 9, 200)
    data = pick.integers(97, 99, (200, 8)).astype(np.uint8)
    prefix = np.zeros((200, 9), np.uint64)
    for column in range(8):
        prefix[:, column + 1] = prefix[:, column] * np.uint64(suffix.BASE) + data[:, column] + np.uint64(1)
    order = suffix._merge_sorted(prefix, data, sizes)
    rows = [bytes(data[k, : sizes[k]]) for k in order]
    assert sorted(order) == list(range(200)) and rows == sorted(rows)


def test_stretches_give_the_same_anchors():
    pick = np.random.default_rng(1)
    text = pick.integers(97, 101, 3_000).astype(np.uint8)
    bounds = np.array([0, 700, 705, 705, 3_000])
    one = suffix.anchors(text, bounds, 40, 10)
    for stretch in (50, 333):
        for a, b in zip(one, suffix.anchors(text, bounds, 40, 10, stretch), strict=True):
            assert (a == b).all()


def test_awkward_rows(spark):
    rows = suffix.remove_repeats(awkward(spark, "kept"), 8, 4).collect()
    assert len(rows) == 11
    assert [r.n_removed for r in rows if r.doc_id == 6] == [8, 8]
    assert {r.n_bytes for r in rows if r.doc_id in (2, 3)} == {0}
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


def test_colliding_hashes_and_large_groups_take_their_paths(spark, monkeypatch):
    names, keep = [], suffix.stored
    monkeypatch.setattr(suffix, "stored", lambda rows, name: names.append(name) or keep(rows, name))
    texts = mixed_texts(3, "abcdefg")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(frame(spark, texts), 20, 6, hash_bits=4, hot_gram=2).collect()}
    assert [found[n] for n in range(len(texts))] == brute([(text or "").encode() for text in texts], 20)
    assert "wrong" in names and names.count("parts") > 3


def test_an_order_by_wrong_hashes_is_noticed():
    data = np.array([[1, 1], [1, 2], [2, 0]], np.uint8)
    sizes = np.array([2, 2, 1])
    assert suffix._in_order(np.array([0, 1, 2]), data, sizes)
    assert not suffix._in_order(np.array([1, 0, 2]), data, sizes)
    assert not suffix._in_order(np.array([0, 0, 2]), data, sizes)

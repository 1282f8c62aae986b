import pytest
from pandas.testing import assert_frame_equal

from pollweave.llm import quality
from pollweave.llm.quality import Policy, Rule

from .helpers import awkward, frame, pandas_pair


def test_query_agrees_with_sql(spark):
    assert_frame_equal(*pandas_pair(spark, "op1_quality_rules", "doc_id"))


def brute(words, span=5):
    windows = [tuple(words[i : i + span]) for i in range(len(words) - span + 1)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(span)})


@pytest.mark.parametrize("text", ["a b c d e f a b c d e g", "a a a a a a a", "x " * 4, "a b c d e", "", "a b c d e a b c d e a"])
def test_repeated_words(text):
    words = text.encode().split()
    assert quality.repeat_words(words) == brute(words)


def test_repeated_words_of_a_large_vocabulary():
    words = [b"%d" % k for k in range(9_000)] + [b"%d" % k for k in range(100, 120)]
    assert quality.repeat_words(words) == 40


def test_awkward_rows(spark):
    rows = quality.ledger(awkward(spark)).collect()
    assert len(rows) == 11
    by_id = {row.doc_id: row for row in rows if row.doc_id not in (1, 6, None)}
    assert by_id[2].n_words == by_id[3].n_words == by_id[4].n_words == 0
    assert by_id[2].fail_bits == by_id[3].fail_bits == (1 | 1 << 7)
    assert by_id[5].n_words == 60_000
    assert by_id[7].n_words == 4 and by_id[7].word_chars == 3 + 1 + 4 + 3
    assert quality.ledger(frame(spark, [])).count() == 0


def test_policies_and_ablation_from_one_ledger(spark):
    rules = (Rule(0, "short", "n_words < 3"), Rule(3, "symbols", "n_symbols > 0"))
    entries = quality.ledger(frame(spark, ["a b c d", "a", "# b c d", "#", "x y z"]), rules)
    strict, lax = Policy("strict", 2, ("short", "symbols")), Policy("lax", 1, ("short",))
    assert {r.doc_id for r in quality.apply_policy(entries, strict, rules).where("kept").collect()} == {0, 4}
    assert {r.doc_id for r in quality.apply_policy(entries, lax, rules).where("kept").collect()} == {0, 2, 4}
    found = {(r.policy, r.rule): tuple(r)[3:] for r in quality.ablation(entries, (strict, lax), rules).collect()}
    assert found == {("strict", "short"): (2, 1, 2, 3), ("strict", "symbols"): (2, 1, 2, 3), ("lax", "short"): (2, 2, 3, 5)}


def test_ablation_of_an_empty_ledger_gives_zeros(spark):
    found = quality.ablation(quality.ledger(frame(spark, [])), (quality.BASE, Policy("it's", 2, ("symbols",)))).collect()
    assert sorted(map(tuple, found)) == [("base", 1, "few_words", 0, 0, 0, 0), ("base", 1, "repeated_words", 0, 0, 0, 0), ("it's", 2, "symbols", 0, 0, 0, 0)]


def test_a_stored_ledger_needs_no_text(spark):
    entries = quality.store_ledger(frame(spark, ["a b c d", None]), rules_version=7)
    assert {(r.doc_id, r.n_words, r.rules_version) for r in entries.collect()} == {(0, 4, 7), (1, 0, 7)}
    plan = quality.apply_policy(entries, quality.FULL)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_bits_must_differ():
    with pytest.raises(ValueError):
        quality.failure_bits((Rule(1, "a", "true"), Rule(1, "b", "true")))

import random

import pytest
from pandas.testing import assert_frame_equal

from pollweave.llm import lines

from .helpers import awkward, frame, pandas_pair


def test_query_agrees_with_sql(spark):
    assert_frame_equal(*pandas_pair(spark, "op4_line_dedup", "doc_id"))


def brute(texts, least):
    """Every run of lines with enough words, compared with every earlier one; lines without a word go inside a shortest run."""
    runs, gone = {}, set()
    for d, text in enumerate(texts):
        own = [(n, line) for n, line in enumerate(text.split("\n")) if line.split()]
        for a in range(len(own)):
            for b in range(a, len(own)):
                if sum(len(line.split()) for _, line in own[a : b + 1]) >= least:
                    runs.setdefault(tuple(line for _, line in own[a : b + 1]), []).append((d, own[a][0], own[b][0]))
    for run, places in runs.items():
        counts = [len(line.split()) for line in run]
        shortest = sum(counts[1:]) < least or sum(counts[:-1]) < least
        for d, first, last in sorted(places)[1:]:
            gone |= {(d, n) for n in range(first, last + 1) if shortest or texts[d].split("\n")[n].split()}
    return {d: ("\n".join(line for n, line in enumerate(text.split("\n")) if (d, n) not in gone)) for d, text in enumerate(texts)}


@pytest.mark.parametrize("least", [1, 2, 5, 9])
def test_all_repeated_runs_go_and_no_other(spark, least):
    pick = random.Random(least)
    pool = [" ".join(pick.choice("abcdef") for _ in range(pick.randint(1, 4))) for _ in range(7)] + ["", "  "]
    texts = ["\n".join(pick.choice(pool) for _ in range(pick.randint(1, 12))) for _ in range(40)]
    texts += [texts[0], texts[0] + "\n" + texts[1], "\n".join(["a b"] * 15)]
    found = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, texts), least).collect()}
    assert found == brute(texts, least)


def test_awkward_rows_keep_their_columns(spark):
    given = awkward(spark, "n_lines").selectExpr("*", "'x' AS spans", "2 AS row", "3 AS text_hash", "4 AS lines")
    out = lines.dedup_lines(given, 2)
    assert out.columns == ["doc_id", "text", "spans", "row", "text_hash", "lines", "n_lines", "n_removed"]
    rows = out.collect()
    assert len(rows) == 11
    assert [r.text for r in rows if r.doc_id == 6] == ["same row", "same row"]
    assert [r.text for r in rows if r.doc_id == 2] == [None]
    assert sum(r.n_removed for r in rows) == 0
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_order_is_by_id_then_hash(spark):
    copy = "one two three\nfour five"
    rows = [(3, copy), (None, copy + "\nx"), (1, copy)]
    found = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, rows), 5).collect()}
    assert found == {None: copy + "\nx", 1: "", 3: ""}


def test_plan_has_no_python(spark):
    plan = lines.dedup_lines(frame(spark, ["a\nb"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_first_place_of_a_fingerprint_is_not_that_of_the_run(spark):
    around = ["one two", "three four", "five six", "seven eight"]
    texts = [f"{around[0]}\nshared line\n{around[1]}"] + [f"{around[2]}\nshared line\n{around[3]}"] * 2
    found = {r.doc_id: r.n_removed for r in lines.dedup_lines(frame(spark, texts), 6).collect()}
    assert found == {0: 0, 1: 0, 2: 3}


@pytest.mark.parametrize("section", [1, 3, 8])
def test_sections_find_the_windows_of_the_whole(spark, section):
    pick = random.Random(section)
    texts = ["\n".join(" ".join(pick.choice("abc") for _ in range(pick.randint(0, 3))) for _ in range(40)) for _ in range(6)]
    docs = lines.identified(frame(spark, texts), "doc_id", "text")
    whole, cut = (lines.windows(docs, 5, n).distinct() for n in (1_000, section))
    assert whole.count() > 100 and whole.exceptAll(cut).count() == cut.exceptAll(whole).count() == 0


def test_a_document_of_many_lines_takes_time_in_proportion(spark):
    """As many lines in one document as would take hours if windows or lines were compared with each other."""
    long = "\n".join(f"w{k % 99_991}" for k in range(150_000))
    found = {r.doc_id: (r.n_lines, r.n_removed) for r in lines.dedup_lines(frame(spark, [long, "other"])).collect()}
    # From line 99,991 on the lines repeat.
    assert found == {0: (150_000, 150_000 - 99_991), 1: (1, 0)}

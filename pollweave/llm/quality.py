"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once per document. The ledger stores what was measured
and one bit per failed rule; a policy is a named mask over those bits, so
another policy, another version of it or an ablation on a stored ledger
(``store_ledger``) never reads a text again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import per_text, stored

SYMBOLS = b"#*$%&|<>"
SPAN = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL predicate over the measures; ``bit`` is its fixed place in the ledger."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of which rules count."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule]) -> int:
        bits = {rule.name: 1 << rule.bit for rule in rules}
        return sum(bits[name] for name in self.rules)


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "long_words", "word_chars > 20 * n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(6, "many_words", "n_words > 100000"),
    Rule(7, "no_words", "n_words = 0"),
)
# To be raised with every change of a rule; a bit keeps its rule for good.
RULES_VERSION = 1
BASE = Policy("base", 1, ("few_words", "repeated_words"))
FULL = Policy("full", 1, ("few_words", "repeated_words", "long_words", "short_words", "symbols", "repeated_lines"))


def repeat_words(words: list[bytes], span: int = SPAN) -> int:
    """How many words lie in a window of ``span`` words that the text holds at least twice."""
    if len(words) <= span:
        return 0
    numbers = {word: n for n, word in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    starts, base = len(ids) - span + 1, len(numbers)
    codes, limit = ids[:starts], base
    for step in range(1, span):
        if limit * base >= 1 << 63:
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
            limit = int(codes.max()) + 1
        codes, limit = codes * base + ids[step : step + starts], limit * base
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(starts + 1, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + span, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _measure(texts: list[bytes]) -> dict[str, list]:
    found: dict[str, list] = {name: [] for name in MEASURES}
    for text in texts:
        words = text.split()  # of bytes: exactly the six ASCII blanks
        lines = [line for line in text.split(b"\n") if line.strip()]
        found["n_words"].append(len(words))
        found["word_chars"].append(len(b"".join(words).decode("utf-8", "replace")))
        found["n_symbols"].append(len(text) - len(text.translate(None, SYMBOLS)))
        found["n_lines"].append(len(lines))
        found["n_dup_lines"].append(len(lines) - len(set(lines)))
        found["n_repeat_words"].append(repeat_words(words))
    return found


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the measures and ``fail_bits``.

    A null or empty text has no words and no lines. Repeated rows give repeated
    entries, a null id stays null, other columns of the input are not read.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    measured = per_text(narrow, _measure, [(name, T.LongType()) for name in MEASURES])
    return measured.withColumn("fail_bits", failure_bits(rules))


def store_ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, rules_version: int = RULES_VERSION, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The ledger, written once into the shared folder with its ``rules_version``: policies and ablations read it, not the texts."""
    return stored(ledger(docs, rules, id_column, text_column).withColumn("rules_version", F.lit(rules_version)), "ledger")


def failure_bits(rules: Sequence[Rule]) -> Column:
    if len({rule.bit for rule in rules}) < len(rules) or any(not 0 <= rule.bit < 63 for rule in rules):
        raise ValueError("every rule needs a bit of its own from 0 to 62")
    total = F.lit(0).cast("long")
    for rule in rules:
        total = total.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return total


def fails(policy: Policy, rules: Sequence[Rule] = RULES, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) != 0


def apply_policy(entries: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with ``policy``, ``policy_version`` and ``kept`` under that policy."""
    return entries.withColumns(
        {
            "policy": F.lit(policy.name),
            "policy_version": F.lit(policy.version),
            "kept": ~fails(policy, rules),
        }
    )


def patterns(entries: DataFrame) -> DataFrame:
    """Documents per pattern of failure bits: all that ablations need, at most 2^rules rows."""
    return entries.groupBy("fail_bits").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


def ablation(entries: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each policy and each of its rules, what leaving that rule out would keep.

    Columns: policy, policy_version, rule, n_failed (documents that fail the
    rule), n_only (that fail no other rule of the policy), n_kept (under the
    whole policy), n_kept_without (with the rule left out). An empty ledger gives zeros.
    """
    bits = {rule.name: 1 << rule.bit for rule in rules}
    wanted = [(p.name, p.version, name, p.mask(rules), bits[name]) for p in policies for name in p.rules]
    names = ("policy", "policy_version", "rule", "mask", "bit")
    rows = F.array(*[F.struct(*[(F.lit(x).cast("long") if n in ("mask", "bit") else F.lit(x)).alias(n) for n, x in zip(names, row, strict=True)]) for row in wanted])
    # A pattern without documents stands in for those that an empty ledger lacks.
    totals = patterns(entries).select("fail_bits", "n_docs")
    totals = totals.unionByName(entries.sparkSession.createDataFrame([(0, 0)], "fail_bits long, n_docs long"))
    seen = totals.withColumn("w", F.explode(rows)).select("w.*", "fail_bits", "n_docs")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n_docs"))), F.lit(0))
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return seen.groupBy("policy", "policy_version", "rule").agg(
        count(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(hit == F.col("bit")).alias("n_only"),
        count(hit == 0).alias("n_kept"),
        count((hit == 0) | (hit == F.col("bit"))).alias("n_kept_without"),
    )

"""Token counts under a unigram model, with scores shared along a trie.

Pre-tokens are the marked words of ``pieces``. The distinct ones of a block of
texts are walked in sorted order, which visits their trie depth first: what two
neighbours share as a prefix was scored once and is kept on a stack, and
a pre-token's count of tokens is read where its path ends.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import chain

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import ENTRY_BYTES, LONG_CHUNK, chunks_of
from .texts import per_text

# Bytes of counted pre-tokens, more or less, that a worker keeps between blocks; beyond it the table starts anew.
# Long pre-tokens are kept for their block alone.
TABLE_BYTES = 64_000_000
# The public vocabularies give ranks, not probabilities: a piece of rank r weighs 1 / (r + this).
RANK_OFFSET = 2.7


def unigram_scores(model: str) -> tuple[dict[str, float], float]:
    """Log weights of the ordinary pieces by rank, and the log weight of one fallback byte."""
    held = sentencepiece.SentencePieceProcessor(model_file=model)
    skip = lambda n: held.is_control(n) or held.is_unknown(n) or held.is_byte(n) or held.is_unused(n)
    pieces = [held.id_to_piece(n) for n in range(held.get_piece_size()) if not skip(n)]
    total = math.log(sum(1 / (rank + RANK_OFFSET) for rank in range(len(pieces))))
    scores = {piece: -math.log(rank + RANK_OFFSET) - total for rank, piece in enumerate(pieces)}
    return scores, -math.log(len(pieces) + RANK_OFFSET) - total


class CountTable:
    """Counts of tokens on the best path of each pre-token.

    The state of a trie node is the best score of a path to it, the tokens on that path, and
    the starts from which a longer piece can still come. Of paths with equal scores the
    one with fewer tokens counts.
    """

    def __init__(self, model: str, size: int = TABLE_BYTES):
        scores, self.byte = unigram_scores(model)
        self.parts: dict[str, float | None] = {piece[:n]: None for piece in scores for n in range(1, len(piece))}
        self.parts |= scores
        self.size = size
        self.counts: dict[str, int] = {}
        self.held = 0
        self.passing: list[str] = []
        self.nodes = 0

    def add(self, tokens: set[str]) -> None:
        """Score the pre-tokens that the table lacks, in trie order."""
        if self.held > self.size:
            self.counts, self.held = {}, 0
        else:
            for token in self.passing:
                del self.counts[token]
        new = sorted(tokens - self.counts.keys())
        self.passing = [token for token in new if len(token) > LONG_CHUNK]
        self.held += sum(ENTRY_BYTES + 4 * len(token) for token in new if len(token) <= LONG_CHUNK)
        parts, stack, last = self.parts, [(0.0, 0, [0])], ""
        for token in new:
            shared = 0
            for ours, theirs in zip(last, token, strict=False):
                if ours != theirs:
                    break
                shared += 1
            del stack[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                top, fewest, alive = -math.inf, 0, [end]
                for start in stack[-1][2]:
                    part = token[start:end]
                    if part in parts:
                        alive.append(start)
                        weight = parts[part]
                        if weight is not None:
                            score, before, _ = stack[start]
                            score += weight
                            if score > top or score == top and before < fewest:
                                top, fewest = score, before + 1
                if parts.get(token[end - 1]) is None:  # a character without a piece falls back to its bytes
                    n, (score, before, _) = len(token[end - 1].encode()), stack[end - 1]
                    score += n * self.byte
                    if score > top or score == top and before + n < fewest:
                        top, fewest = score, before + n
                stack.append((top, fewest, alive))
            self.nodes += len(token) - shared
            last = token
            self.counts[token] = stack[len(token)][1]


@cache
def table(model: str, size: int) -> CountTable:
    return CountTable(model, size)


def _counted(texts: list[bytes], model: str, size: int) -> dict[str, list]:
    chunked = [chunks_of(text.decode("utf-8", "replace")) for text in texts]
    held = table(model, size)
    held.add(set(chain.from_iterable(chunked)))
    return {
        "n_pretokens": list(map(len, chunked)),
        "n_tokens": [sum(map(held.counts.__getitem__, tokens)) for tokens in chunked],
    }


def token_counts(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``doc_id``, ``n_pretokens`` and ``n_tokens`` for every input row, whole texts.

    A null or empty text counts 0 and 0. Rows are counted alone, so repeated
    rows and null ids give a row each; other columns are not read.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    fields = [("n_pretokens", T.LongType()), ("n_tokens", T.LongType())]
    return per_text(narrow, lambda texts: _counted(texts, model, table_bytes), fields)

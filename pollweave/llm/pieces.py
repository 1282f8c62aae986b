"""SentencePiece ids through a table of distinct chunks.

The text is normalised as the model does it (blanks become the marker U+2581, one
marker goes in front) and cut where a marker follows another character. The
vocabulary is checked to hold no piece with a marker inside, so no piece
crosses a cut. Each distinct chunk of a task is segmented once; the ids come
back to the texts by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import per_text

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
GUARD = "a"
# Bytes of segmented chunks, more or less, that a worker keeps between blocks; beyond it the table starts anew.
TABLE_BYTES = 64_000_000
# What an entry takes besides its characters: two string heads and a place in the table.
ENTRY_BYTES = 160
# Longer chunks, as of text without blanks, hardly ever come again: they are kept for their block alone.
LONG_CHUNK = 200
# Chunks that are segmented in one call, whose ids are lists meanwhile.
AT_ONCE = 5_000


class ChunkTable:
    """Distinct chunks, each with its ids.

    A chunk is segmented behind a guard word whose single id is then cut off, so a
    chunk of markers alone, or in the middle of a text, gets the ids it has there.
    The ids are kept as text, which takes a fraction of the memory of lists. ``held`` counts
    the bytes of the entries that stay; what a block adds is bounded by its texts.
    """

    def __init__(self, model: str, size: int = TABLE_BYTES):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = size
        pieces = (self.model.id_to_piece(n) for n in range(self.model.get_piece_size()))
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("this vocabulary has pieces that cross a marker")
        self.guard = self.model.encode(GUARD)
        if len(self.guard) != 1:
            raise ValueError("the guard word is not one piece of this vocabulary")
        self.ids: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.held = 0
        self.passing: list[str] = []

    def add(self, chunks: list[str]) -> None:
        """Segment the chunks that the table lacks, and decode them; ``odd`` holds those that decode to something else."""
        if self.held > self.size:
            self.ids, self.odd, self.held = {}, {}, 0
        else:
            for chunk in self.passing:
                del self.ids[chunk]
                self.odd.pop(chunk, None)
        known = self.ids
        new = list({chunk for chunk in chunks if chunk not in known})
        self.passing = [chunk for chunk in new if len(chunk) > LONG_CHUNK]
        plain = [GUARD + chunk.replace(MARK, " ") for chunk in new]
        for start in range(0, len(new), AT_ONCE):
            own, texts = new[start : start + AT_ONCE], plain[start : start + AT_ONCE]
            ids = self.model.encode(texts, num_threads=1)
            decoded = self.model.decode([self.guard + one[1:] for one in ids], num_threads=1)
            joined = [",".join(map(str, one[1:])) for one in ids]
            known.update(zip(own, joined, strict=True))
            # A character takes up to four bytes in a string.
            self.held += sum(ENTRY_BYTES + 4 * len(chunk) + len(text) for chunk, text in zip(own, joined, strict=True) if len(chunk) <= LONG_CHUNK)
            self.odd.update({chunk: got[len(GUARD) :] for chunk, text, got in zip(own, texts, decoded, strict=True) if got != text})

    def encoded(self, chunks: list[str]) -> str:
        """Ids of a text in decimal, joined by commas, from its chunks in order."""
        return ",".join(map(self.ids.__getitem__, chunks))

    def decoded(self, chunks: list[str], text: str) -> str:
        """What the ids decode to: the chunks' decoded texts in order, without the blank that stands in front."""
        if self.odd and not self.odd.keys().isdisjoint(chunks):
            return "".join(self.odd.get(chunk, chunk.replace(MARK, " ")) for chunk in chunks)[1:]
        return text.replace(MARK, " ")


@cache
def table(model: str, size: int) -> ChunkTable:
    return ChunkTable(model, size)


def chunks_of(text: str) -> list[str]:
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def _worked(texts: list[bytes], model: str, size: int) -> Iterator[tuple[str, str]]:
    """Ids joined by commas, and decoded text, of each text."""
    plain = [text.decode("utf-8", "replace") for text in texts]
    chunked = [chunks_of(text) for text in plain]
    held = table(model, size)
    held.add(list(chain.from_iterable(chunked)))
    for text, chunks in zip(plain, chunked, strict=True):
        yield held.encoded(chunks), held.decoded(chunks, text)


def _digests(texts: list[bytes], model: str, size: int) -> dict[str, list]:
    found: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for ids, decoded in _worked(texts, model, size):
        found["n_tokens"].append(ids.count(",") + 1 if ids else 0)
        found["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
        found["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
    return found


def _encoded(texts: list[bytes], model: str, size: int) -> dict[str, list]:
    found = list(_worked(texts, model, size))
    return {"ids": [list(map(int, ids.split(","))) if ids else [] for ids, _ in found], "decoded": [text for _, text in found]}


def _narrow(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))


def encode_decode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` for every input row, whole texts.

    A null or empty text has no ids and decodes to the empty text. Rows are
    worked on alone: repeated rows and ids, and null ids, give a row each.
    """
    work = lambda texts: _encoded(texts, model, table_bytes)
    return per_text(_narrow(docs, id_column, text_column), work, [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())])


def encode_digests(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """As ``encode_decode``, but token counts and digests in place of the ids and texts themselves."""
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return per_text(_narrow(docs, id_column, text_column), lambda texts: _digests(texts, model, table_bytes), fields)


def decode(encoded: DataFrame, model: str, ids_column: str = "ids") -> DataFrame:
    """Decode stored ids; a null list is decoded as an empty one."""
    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        held = table(model, TABLE_BYTES).model
        return ids.map(lambda own: held.decode([int(n) for n in own]) if own is not None else "")

    return encoded.withColumn("decoded", text(F.col(ids_column)))

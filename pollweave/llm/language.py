"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sample text. A text goes
to the language whose dictionary makes it smallest; how much smaller than with
the second best one is the score, and a narrow margin is a rejection. A text is encoded in blocks
of fixed size, so its own repetitions do not wash out the dictionaries' part.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from itertools import groupby

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import per_text

# Bounds of the sample that the dictionaries are made of.
SAMPLE_TEXTS = 200  # texts of each language
SAMPLE_CHARS = 4_000  # characters of each of them; more where so few texts would not fill the dictionary
DICTIONARY_BYTES = 65_536  # bytes of each dictionary
TEXT_BYTES = 2_048  # bytes that a text gives in its turn; there are further turns while the dictionary is not full
MOST_LANGUAGES = 500

BLOCK = 1_024
LEVEL = 5
# Sizes of short texts are whole numbers that often tie; there the sizes of several levels are added.
SHORT, SHORT_LEVELS = 512, (3, 5, 12)
MARGIN = 0.01
UNDETERMINED = "und"

NOT_LETTERS = re.compile(r"[\W\d_]+")
# Signs for numbers that are neither digits nor letters, as ½, ², ① and Ⅷ; \w takes them in.
_SIGNS = "".join(sign for sign in map(chr, range(0x80, 0x110000)) if sign.isalnum() and not sign.isalpha() and not sign.isdecimal())
NUMBER_SIGNS = re.compile(f" ?[{_SIGNS}][ {_SIGNS}]*")
# The sample is drawn from so many groups of partitions first, so that no task meets the rows of every partition.
SAMPLE_GROUPS = 512


def letters(text: str) -> bytes:
    """Lower-cased words of letters (``str.isalpha``) between single blanks; empty without a letter."""
    plain = NOT_LETTERS.sub(" ", text.lower())
    # Asked first, because the pattern with its many signs is slow and few texts have one.
    if not plain.isascii() and not plain.replace(" ", "").isalpha():
        plain = NUMBER_SIGNS.sub(" ", plain)
    plain = plain.strip()
    return f" {plain} ".encode() if plain else b""


def filled(texts: list[bytes], dictionary_bytes: int = DICTIONARY_BYTES, text_bytes: int = TEXT_BYTES) -> bytes:
    """The first ``text_bytes`` of every text, then the next of every text, until the dictionary is full or the texts are used up."""
    turns = range(0, max(map(len, texts), default=0), text_bytes)
    return b"".join(text[at : at + text_bytes] for at in turns for text in texts)[:dictionary_bytes]


def learn(
    docs: DataFrame,
    label: str = "lang",
    text_column: str = "text",
    use: Column | None = None,
    sample_texts: int = SAMPLE_TEXTS,
    dictionary_bytes: int = DICTIONARY_BYTES,
    text_bytes: int = TEXT_BYTES,
) -> dict[str, bytes]:
    """A dictionary for each label, from a bounded sample of the rows with a label and a text.

    The sample takes the texts with the smallest hashes, so it does not depend on
    ids, order, partitions or copies: texts of a label that agree in their first
    ``SAMPLE_CHARS`` characters are one text. Lines that several sampled texts share,
    or that one has under several labels, are left out. Of what is left, every text
    gives ``text_bytes`` in turn until the dictionary has ``dictionary_bytes``; a label
    with few texts has longer parts of them sampled, so that they can fill it.
    """
    labelled = docs.select(F.col(label).cast("string").alias("label"), F.col(text_column).alias("text"), (F.lit(True) if use is None else use).alias("use"))
    labelled = labelled.where("use AND label IS NOT NULL AND text IS NOT NULL").withColumn("place", F.xxhash64("text"))
    if len(labelled.select("label").distinct().limit(MOST_LANGUAGES + 1).collect()) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")
    labelled = labelled.withColumn("alike", F.xxhash64(F.substring("text", 1, SAMPLE_CHARS)))
    # Copies go by hashes alone, so no text is shuffled but those of the sample.
    own = Window.partitionBy("label")
    first = own.orderBy("place", "alike")
    texts = labelled.groupBy("label", "alike").agg(F.min("place").alias("place")).withColumn("part", F.spark_partition_id() % SAMPLE_GROUPS)
    near = texts.withColumn("n", F.row_number().over(Window.partitionBy("label", "part").orderBy("place", "alike"))).where(F.col("n") <= sample_texts)
    chosen = near.drop("part").withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_texts)
    # Twice the bytes that are wanted, for what letters() and shared lines take away.
    chosen = chosen.withColumn("chars", F.greatest(F.lit(SAMPLE_CHARS), F.ceil(2 * dictionary_bytes / F.count(F.lit(1)).over(own)).cast("int")))
    sample = labelled.join(F.broadcast(chosen), ["label", "alike", "place"]).select("label", "n", F.substring("text", F.lit(1), F.col("chars")).alias("text"))
    rows = sample.groupBy("label", "n").agg(F.min("text").alias("text")).orderBy("label", "n").collect()
    shared = Counter(line for row in rows for line in set(row.text.split("\n")))
    found = {}
    for name, texts in groupby(rows, key=lambda row: row.label):
        left = [letters("\n".join(line for line in row.text.split("\n") if shared[line] < 2)) for row in texts]
        found[name] = filled(left, dictionary_bytes, text_bytes)
    return {name: content for name, content in sorted(found.items()) if content}


@cache
def _compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> list[zstandard.ZstdCompressor]:
    return [
        zstandard.ZstdCompressor(
            level=level,
            dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )
        for _, content in dictionaries
    ]


def sizes(plain: bytes, dictionaries: tuple[tuple[str, bytes], ...]) -> list[int]:
    """Bytes of the text under each dictionary."""
    cut = [plain[at : at + BLOCK] for at in range(0, len(plain), BLOCK)]
    total = [0] * len(dictionaries)
    for level in SHORT_LEVELS if len(plain) < SHORT else (LEVEL,):
        for n, compressor in enumerate(_compressors(dictionaries, level)):
            total[n] += sum(len(compressor.compress(block)) for block in cut)
    return total


def _predicted(texts: list[bytes], dictionaries: tuple[tuple[str, bytes], ...], margin: float) -> dict[str, list]:
    found: dict[str, list] = {"lang_pred": [], "score": [], "rejected": []}
    for text in texts:
        plain = letters(text.decode("utf-8", "replace"))
        name, score = UNDETERMINED, 0.0
        if plain and dictionaries:
            own = sizes(plain, dictionaries)
            best = min(range(len(own)), key=own.__getitem__)
            second = min((size for n, size in enumerate(own) if n != best), default=2 * own[best])
            name, score = dictionaries[best][0], (second - own[best]) / second
        found["lang_pred"].append(name)
        found["score"].append(score)
        found["rejected"].append(name == UNDETERMINED or score < margin)
    return found


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text_column: str = "text", keep: tuple[str, ...] = ("doc_id",), margin: float = MARGIN) -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` (0 to 1) and ``rejected`` for every row, from its whole text.

    A text that is null or without letters is ``und`` with score 0, and rejected. A
    tie goes to the first label in order, with score 0. With one language learned the
    score is 0.5. Repeated rows are predicted alike. The dictionaries are at most
    ``MOST_LANGUAGES`` times ``DICTIONARY_BYTES`` and travel with the task.
    """
    held = tuple(sorted(dictionaries.items()))
    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]
    return per_text(docs, lambda texts: _predicted(texts, held, margin), fields, keep, text_column)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 2 by 4; null where the id is null."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pollweave.llm import counts, pieces
from pollweave.llm.queries import QUERIES
from pollweave.llm.texts import BATCH_BYTES, mapped

from .helpers import FOLDER, awkward, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a ", " a", "a   b  ", "▁", "a▁b", "\n\n x\ty", "<s>x</s>", "日本😀é", "x" * 3000, None, "ab " * 500, "\u00a0z\u2003 \x00 q", "[INST] ▁▁ \\n"]


def test_ids_and_text_are_those_of_the_library(spark):
    held = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = {r.doc_id: (list(r.ids), r.decoded) for r in pieces.encode_decode(frame(spark, TEXTS), MODEL).collect()}
    for n, text in enumerate(TEXTS):
        ids = held.encode(text or "")
        assert found[n] == (ids, held.decode(ids)), text


def test_a_small_table_gives_the_same(spark):
    one, two = (pieces.encode_digests(frame(spark, TEXTS), MODEL, table_bytes=n).orderBy("doc_id").collect() for n in (1, 1_000_000))
    assert one == two


def test_query_digests(spark):
    held = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op2_sentencepiece"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = held.encode(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(held.decode(ids).encode()).hexdigest()


def test_awkward_rows_and_decode(spark):
    found = pieces.encode_decode(awkward(spark, "ids"), MODEL)
    assert found.count() == 11
    again = pieces.decode(found.withColumnRenamed("decoded", "first"), MODEL)
    assert again.where("NOT (decoded <=> first)").count() == 0
    assert pieces.encode_decode(frame(spark, []), MODEL).count() == 0


def brute_count(token, scores, byte):
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        ways = [(best[s][0] + scores[token[s:end]], best[s][1] - 1) for s in range(end) if token[s:end] in scores]
        if token[end - 1] not in scores:
            n = len(token[end - 1].encode())
            ways.append((best[end - 1][0] + n * byte, best[end - 1][1] - n))
        best.append(max(ways))
    return -best[-1][1]


def test_token_counts_are_those_of_each_pretoken_alone(spark):
    scores, byte = counts.unigram_scores(MODEL)
    rows = {r.doc_id: r for r in counts.token_counts(frame(spark, TEXTS), MODEL).collect()}
    for n, text in enumerate(TEXTS):
        if text != "x" * 3000:
            tokens = pieces.chunks_of(text or "")
            assert rows[n].n_pretokens == len(tokens)
            assert rows[n].n_tokens == sum(brute_count(token, scores, byte) for token in tokens), text
    assert counts.token_counts(awkward(spark), MODEL).count() == 11
    assert counts.token_counts(frame(spark, []), MODEL).count() == 0


def test_prefixes_are_scored_once():
    held = counts.CountTable(MODEL)
    held.add({"▁there", "▁therefore", "▁thereby", "▁other"})
    assert held.nodes == len("▁therefore") + len("by") + len("other")


def test_query_counts(spark):
    scores, byte = counts.unigram_scores(MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op9_token_counts"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.n_tokens == sum(brute_count(token, scores, byte) for token in pieces.chunks_of(texts[row.doc_id]))


@pytest.mark.parametrize("table", [lambda: pieces.ChunkTable(MODEL, 100_000), lambda: counts.CountTable(MODEL, 100_000)])
def test_tables_are_bounded_by_bytes(table):
    """Distinct long chunks are not kept, and the kept ones stay near the bound."""
    held = table()
    kept = lambda: held.ids if isinstance(held, pieces.ChunkTable) else held.counts
    for block in range(200):
        long = {pieces.MARK + f"{block}-{k}-" + "xy" * 1500 for k in range(3)}
        short = {pieces.MARK + f"w{block}q{k}" for k in range(20)}
        held.add(long | short if isinstance(held, counts.CountTable) else [*long, *short, *long])
        assert long | short <= kept().keys()
        assert sum(len(chunk) > pieces.LONG_CHUNK for chunk in kept()) == 3
        assert held.held < 100_000 + 20 * 300
        assert sum(map(len, kept())) < 100_000


def test_long_chunks_that_come_again(spark):
    long = "ab" * 400 + "é"
    texts = [long, f"{long} x {long}", "", f"x {long}", long] * 3
    held = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = {r.doc_id: (r.ids, r.decoded) for r in pieces.encode_decode(frame(spark, texts), MODEL, table_bytes=10).collect()}
    assert found == {n: (held.encode(text), held.decode(held.encode(text))) for n, text in enumerate(texts)}


def test_batches_for_a_worker_are_bounded_by_bytes(spark):
    """However few rows they have: JVM and worker hold them beside the heap."""
    texts = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text"))
    sizes = [r.n for r in mapped(texts, _sizes, "n long").collect()]
    assert sum(sizes) >= 600 * 50_000 and max(sizes) <= BATCH_BYTES + 100_000


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

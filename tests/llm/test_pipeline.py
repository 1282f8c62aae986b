import corpus_pipeline
import public_tokenizers
import sentencepiece

from pollweave.llm import language
from pollweave.llm.queries import PIECE_MODEL

from .helpers import FOLDER
from .test_decontam import brute as windows
from .test_lines import brute as without_lines
from .test_ngrams import brute as classes


def test_run_against_brute_force_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    known = language.learn(docs)
    told = language.predict(docs, known, keep=tuple(docs.columns)).where("NOT rejected").orderBy("doc_id").collect()
    left = [(r.doc_id, r.text) for r in told]

    # A text of fewer than 50 words has no run to lose; brute force over all runs would be slow on the others.
    kept = quick_lines([text for _, text in left])
    left = [(key, new) for (key, old), new in zip(left, kept, strict=True) if new == old or new.split()]
    left = [(key, text) for key, text in left if classes(left)[key][0] == key] if len(left) < 50 else first_of(left)
    left = [(key, text) for (key, text), (n, hit, _) in zip(left, windows([t for _, t in left], items, 13), strict=True) if not (hit and 20 * hit >= n)]

    held = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))
    found = {r.doc_id: (list(r.ids), r.decoded) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert found == {key: (held.encode(text), held.decode(held.encode(text))) for key, text in left}


def quick_lines(texts):
    found = without_lines(texts, 50)
    return [found[n] for n in range(len(texts))]


def first_of(rows):
    found = classes(rows)
    return [(key, text) for key, text in rows if found[key][0] == key]


def test_stages_keep_the_columns_and_stand_awkward_rows(spark):
    rows = [(1, "das ist und der die das", "de", "s", 1), (2, None, None, None, None), (None, "", "en", "s", 0), (3, "the of and the of a", "en", "s", 3), (3, "the of and the of a", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        frame = given
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, FOLDER)
            assert name == "sentencepiece" or frame.columns == docs.columns
            frame.count()

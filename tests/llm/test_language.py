from pyspark.sql import functions as F

from pollweave.llm import language
from pollweave.llm.queries import QUERIES

from .helpers import FOLDER, awkward, frame


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op8_language_id"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(docs.where("lang IS NOT NULL"), "doc_id").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    one = language.learn(docs, use=~language.held_out())
    two = language.learn(docs.where(~language.held_out()))
    assert one == two and set(one) == {r.lang for r in docs.select("lang").distinct().collect() if r.lang}


def test_awkward_rows(spark):
    known = {"en": b" the cat and the dog of the house ", "de": " der hund und die katze im haus über ".encode()}
    rows = language.predict(awkward(spark, "score"), known).collect()
    assert len(rows) == 11
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"}
    assert language.predict(frame(spark, []), known).count() == 0
    assert [r.lang_pred for r in language.predict(frame(spark, ["text"]), {}).collect()] == ["und"]
    two = language.predict(frame(spark, ["der hund und die katze", "123 ..."]), known).orderBy("doc_id").collect()
    assert two[0].lang_pred == "de" and not two[0].rejected and two[1].lang_pred == "und" and two[1].rejected


def test_learning_from_nothing(spark):
    assert language.learn(spark.createDataFrame([(None, "a"), ("en", None)], "lang string, text string")) == {}


def test_copies_teach_once(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    once = language.learn(docs)
    heads = docs.groupBy("lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    copies = heads.union(docs.where("length(text) > 2000").limit(1)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(1_000)))).drop("copy")
    assert len(once) == 4 and language.learn(docs.union(copies)) == once
    assert language.learn(docs.union(docs).union(docs)) == once


def test_a_language_of_repeated_rows_is_learned(spark):
    rows = [("aa", "der hund und die katze\nim haus")] * 300 + [("bb", "the cat and the dog")] * 2 + [("bb", "of the house")] * 300
    found = language.learn(frame(spark, rows, "lang string, text string"))
    assert found["aa"] == b" der hund und die katze im haus " and sorted(found["bb"].split()) == sorted(b"the cat and the dog of the house".split())


def test_texts_with_one_long_beginning_are_one(spark):
    long = "\n".join(f"linea numero {'abcdefghij'[k % 10] * (1 + k // 10)}" for k in range(300))
    assert len(long) > language.SAMPLE_CHARS
    rows = [("es", f"{long}\n{k}") for k in range(50)]
    assert language.learn(frame(spark, rows, "lang string, text string")) == language.learn(frame(spark, [("es", long)], "lang string, text string")) != {}


def test_lines_of_several_texts_are_left_out(spark):
    rows = [("aa", "eins\nzwei"), ("aa", "eins\ndrei"), ("bb", "one\nzwei"), ("bb", "both"), ("cc", "both")]
    found = language.learn(frame(spark, rows, "lang string, text string"))
    assert found == {"aa": b" drei ", "bb": b" one "}


def _words(n, start=0):
    """n different words of letters."""
    return " ".join("".join("abcdefghij"[int(d)] for d in str(1_000_000 + start + k)) for k in range(n))


def test_few_long_texts_fill_the_dictionary(spark):
    one = _words(12_500)  # 100 KB
    rows = [("one", one)] + [("ten", _words(1_250, 100_000 * (k + 1))) for k in range(10)] + [("short", "just a few words")]
    found = language.learn(frame(spark, rows, "lang string, text string"))
    assert {name: len(held) for name, held in found.items()} == {"one": 65_536, "ten": 65_536, "short": 18}
    assert found["one"] == language.letters(one)[:65_536]


def test_texts_give_their_bytes_in_turn(spark):
    assert language.filled([b"abcdef", b"gh", b"ijkl"], 100, 2) == b"abghijcdklef"
    assert language.filled([b"abcdef", b"gh", b"ijkl"], 7, 2) == b"abghijc"
    assert language.filled([], 7, 2) == b""
    rows = [("aa", "eins zwei drei"), ("aa", "vier acht neun")]
    found = language.learn(frame(spark, rows, "lang string, text string"), dictionary_bytes=15, text_bytes=5)["aa"]
    assert len(found) == 15 and {found[:5], found[5:10]} == {b" eins", b" vier"} and found[10:] in (b" zwei", b" acht")


def test_number_signs_are_no_letters(spark):
    known = {"de": b" der hund und die katze ", "en": b" the cat and the dog "}
    for text in ("½", "²", "①", "Ⅷ", "½ ² ①", "1 ½ _ Ⅷ!", "٣", "_"):
        assert language.letters(text) == b"", text
        assert not any(sign.isalpha() for sign in text)
    rows = language.predict(frame(spark, ["½ ² ①", "Ⅷ", "½ der hund ② und Ⅷ die katze"]), known).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "de"] and [r.score for r in rows[:2]] == [0.0, 0.0]
    assert language.letters("½ der² ① hund Ⅷ") == b" der hund "


def test_predictions_against_sizes_taken_anew(spark):
    import unicodedata

    import zstandard

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = language.learn(docs, use=~language.held_out())
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    signs = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in map(chr, range(0x110000)))

    def brute(text):
        plain = " ".join("".join(signs[ord(c)] for c in (text or "").lower()).split())
        if not plain:
            return "und", 0.0
        plain = f" {plain} ".encode()
        sizes = []
        for name in sorted(known):
            total = 0
            for level in (3, 5, 12) if len(plain) < 512 else (5,):
                held = zstandard.ZstdCompressionDict(known[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                press = zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
                total += sum(len(press.compress(plain[at : at + 1024])) for at in range(0, len(plain), 1024))
            sizes.append((total, name))
        (best, name), (second, _) = sorted(sizes)[:2]
        return name, (second - best) / second

    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, known).collect()}
    assert found == {doc_id: brute(text) for doc_id, text in texts.items()}

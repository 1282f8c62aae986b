"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, counts, decontam, language, lines, ngrams, pieces, quality, resampling, suffix, urls, warc, whitening
from .registry import ORACLES, QUERIES, documents, query
from .texts import sha

__all__ = ["ORACLES", "QUERIES"]

PIECE_MODEL = "piece_bpe_32k.model"

QUALITY_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\v\\f\\r]')) AS ls
  FROM t),
g AS (
  SELECT doc_id, ws, i, list_slice(ws, i, i + 4) AS five
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g) WHERE n > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[ \\t\\n\\v\\f\\r]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeated r ON r.doc_id = w.doc_id),
b AS (
  SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (word_chars > 20 * n_words)::BIGINT
    + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (10 * n_symbols > n_words)::BIGINT + 32 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
    + 64 * (n_words > 100000)::BIGINT + 128 * (n_words = 0)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, fail_bits,
  'full' AS policy, 1 AS policy_version, fail_bits & 63 = 0 AS kept, fail_bits & 3 <> 0 AS base_failed
FROM b
"""


@query("op1_quality_rules", QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    entries = quality.ledger(documents(spark, folder))
    return quality.apply_policy(entries, quality.FULL).withColumn("base_failed", quality.fails(quality.BASE))


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_digests(documents(spark, folder), public_tokenizers.path(PIECE_MODEL))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    dictionaries = language.learn(docs, use=~language.held_out())
    out = language.predict(docs, dictionaries).withColumn("held_out", F.coalesce(language.held_out(), F.lit(False)))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.token_counts(documents(spark, folder), public_tokenizers.path(PIECE_MODEL))


def _chat_sql(template: chat.Template) -> str:
    """Digests of the turns and of the loss text, and the length of marks and escaped texts."""
    marks = "".join(f" WHEN '{role}' THEN {len(turn.before) + len(turn.after)}" for role, turn in template.turns.items())
    special = "|".join(["\\\\", *(re.sub(r"([\[\]])", r"\\\1", control) for control in template.controls)])
    escapes = lambda text: f"len(regexp_extract_all({text}, '{special}'))"
    moves = ", ".join(f"('{state}', '{role}')" for state, roles in template.follows.items() for role in sorted(roles))
    loss = ", ".join(f"'{role}'" for role, turn in template.turns.items() if turn.loss)
    ends = ", ".join(f"'{role}'" for role in template.ends)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS n, lag(role, 1, '') OVER w AS state FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role IN ({loss})), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role IN ({loss})), '')) AS loss_sha256,
  sum(length(text) + {escapes("text")} + CASE role{marks} ELSE {sum(map(len, template.other))} + length(role) + {escapes("role")} END)::BIGINT AS formatted_chars,
  bool_and((state, role) IN ({moves})) AND arg_max(role, n) IN ({ends}) AS legal
FROM o GROUP BY conv_id
"""


@query("op3_chat_format", _chat_sql(chat.INSTRUCT))
def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], given.schema)
    return chat.read_back(chat.format_chats(given.unionByName(extra)))


DECONTAMINATION_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, len(ws) AS n, ws AS win FROM b WHERE len(ws) BETWEEN 1 AND 12
  UNION
  SELECT DISTINCT item_id, 13 AS n, list_slice(ws, i, i + 12) AS win FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM b WHERE len(ws) >= 13)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, list_slice(ws, i, i + n - 1) AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.win = dw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


@query("op6_decontamination", DECONTAMINATION_SQL)
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.matches(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return decontam.contamination(found).drop("n_near_items")


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
URL_SQL = f"""
WITH rules(rh, rp, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
h AS (
  SELECT host, path, max_by({{'rule': rh || rp, 'verdict': v}}, length(rh || rp)) AS best
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM p LEFT JOIN h ON h.host = p.host AND h.path = p.path
"""


@query("op10_url_filters", URL_SQL)
def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.apply_rules(spark.read.parquet(f"{folder}/pages.parquet"), rules)


LINE_SQL = """
WITH lines AS (
  SELECT doc_id, n - 1 AS n, line, len(list_filter(string_split_regex(line, '[ \t\n\v\f\r]+'), lambda x: x <> '')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
l AS (
  SELECT *, row_number() OVER d AS i, sum(w) OVER d AS c
  FROM lines WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
ahead AS (
  SELECT a.doc_id, a.i, min(b.i) AS j
  FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + 49 WHERE b.c - a.c + a.w >= 50 GROUP BY a.doc_id, a.i),
behind AS (
  SELECT b.doc_id, max(a.i) AS i, b.i AS j
  FROM l a JOIN l b ON b.doc_id = a.doc_id AND a.i BETWEEN b.i - 49 AND b.i WHERE b.c - a.c + a.w >= 50 GROUP BY b.doc_id, b.i),
win AS (SELECT * FROM ahead UNION SELECT * FROM behind),
run AS (
  SELECT win.doc_id, win.i, win.j, string_agg(line, chr(10) ORDER BY l.i) AS run, min(n) AS first, max(n) AS last
  FROM win JOIN l ON l.doc_id = win.doc_id AND l.i BETWEEN win.i AND win.j GROUP BY win.doc_id, win.i, win.j),
placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS k FROM run),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS n FROM placed WHERE k > 1),
kept AS (
  SELECT lines.doc_id, count(*) AS n_lines, count(gone.n) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY lines.n) FILTER (WHERE gone.n IS NULL), '') AS text
  FROM lines LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.n = lines.n GROUP BY lines.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  length(kept.text)::BIGINT AS kept_chars, sha256(kept.text) AS kept_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


@query("op4_line_dedup", LINE_SQL)
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.dedup_lines(documents(spark, folder).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), sha(F.col("text")).alias("kept_sha256"))


# Every string of 200 bytes, by its digest; texts as hexadecimal digits, two for a byte.
REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM d WHERE len(h) >= 400)),
r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
b AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM b),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS z FROM i GROUP BY doc_id, run),
f AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM s),
k AS (
  SELECT f.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS front, max(z) AS rest
  FROM f JOIN d ON d.doc_id = f.doc_id GROUP BY f.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


@query("op7_suffix_dedup", REPEATS_SQL)
def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, folder)).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


# Every pair with an n-gram in common, and the closure of the links: exact, for small tables.
NGRAM_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, 'short ' || array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
s AS (SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS set_id FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b, sb.set_id AS b_set, sa.set_id = sb.set_id AS same
  FROM c JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 5 * common >= 4 * (sa.n + sb.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
copy AS (SELECT set_id, min(doc_id) AS copy_id FROM s GROUP BY set_id),
n AS (SELECT a AS doc_id, count(*) AS n_links, count(DISTINCT b_set) FILTER (WHERE NOT same) AS n_texts FROM links GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(copy_id, d.doc_id) AS copy_id, coalesce(n_links, 0)::BIGINT AS n_links,
  coalesce(n_texts, 0)::BIGINT AS n_texts, coalesce(s.n, 0)::BIGINT AS n_grams
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN class ON class.doc_id = d.doc_id LEFT JOIN copy ON copy.set_id = s.set_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op5_ngram_join", NGRAM_SQL)
def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngrams.similar(documents(spark, folder))
    return found.select("doc_id", F.col("class_doc").alias("class_id"), "copy_id", "n_links", "n_texts", "n_grams")


# CRC-32 from its table of 256 values; distinct words alone are hashed.
RESAMPLING_SQL = """
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
texts AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
w AS (
  SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM texts),
c AS (SELECT side, id, word, count(*) AS n FROM w GROUP BY ALL),
b AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM c), bits),
k AS (SELECT side, id, bucket, sum(n)::BIGINT AS n FROM c JOIN b ON b.word = c.word GROUP BY ALL),
u AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 's'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0)::BIGINT AS t FROM k GROUP BY bucket),
a AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM u),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM u, a),
d AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM k JOIN g ON g.bucket = k.bucket WHERE side = 's' GROUP BY id),
m AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce((total - (total % n_features + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN d ON d.id = doc_id),
r AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM m),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM r LEFT JOIN o ON o.doc_id = r.doc_id
"""


@query("op13_target_resampling", RESAMPLING_SQL)
def op13_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = resampling.resample(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


# Five hexadecimal digits of SHA-1 are four of base32.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS largest FROM p GROUP BY html),
d AS (SELECT p.page_id, p.html, sha1(p.html) AS h, largest FROM p JOIN g ON g.html = p.html)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM d
"""


@query("op12_warc_index", WARC_SQL)
def op12_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    archive = warc.write_archive(pages)
    found = warc.read_records(archive, warc.lookup(archive, warc.entries(pages)), payloads=False)
    return found.drop("url")


# Eigenvectors have no SQL; the tests compare with a full eigendecomposition.
@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))

import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pandas.testing import assert_frame_equal

from pollweave.llm import warc

from .helpers import pandas_pair


def test_query_agrees_with_sql(spark):
    assert_frame_equal(*pandas_pair(spark, "op12_warc_index", "page_id"), check_dtype=False)


def some_pages():
    pick = random.Random(5)
    hosts = ["a.example.com", "b.example.com", "example.org", "Big.Example.COM", "ü.de", "127.0.0.1"]
    rows = [(n, f"https://{pick.choice(hosts)}/{pick.randint(0, 30)}?q={n % 3}", f"<p>{'body ' * pick.randint(0, 4)}</p>") for n in range(300)]
    rows += [(300 + n, "http://hot.example.net/", "<p>same</p>") for n in range(200)]
    rows += [(600, None, "null url"), (601, "", ""), (602, "no scheme /x", None), (603, "http://a/\r\nWARC-Type: x y", "é\r\n\r\nWARC/1.1"), (604, "http://long/" + "z" * 5000, "q" * 2_000_000)]
    rows += [(605, "http://twice/", "twice"), (605, "http://twice/", "twice"), (None, "http://none/", "twice"), (None, "http://none/2", "no id"), (None, "http://none/2", "no id"), (-7, "http://minus/", "minus")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "1 AS original", "'f' AS file").repartition(5)


def brute(rows, least_bytes):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        largest = max((one for one in groups[html or ""] if one is not None), default=None)
        revisit = len(body) >= least_bytes and largest is not None and page_id != largest
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page_id, len(body), digest, "revisit" if revisit else "response", largest if revisit else None))
    return Counter(map(repr, out))


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least_bytes, file_bytes, block_lines, n_parts", [(0, 10**9, 3000, None), (10, 500, 3, 7)])
def test_archive_against_brute_force(spark, tmp_path, least_bytes, file_bytes, block_lines, n_parts):
    rows = some_pages()
    pages = frame(spark, rows)
    archive = warc.write_archive(pages, str(tmp_path), least_bytes=least_bytes, file_bytes=file_bytes, block_lines=block_lines, n_parts=n_parts)
    assert archive.parts.agg({"n_captures": "sum"}).first()[0] == len(rows) and archive.parts.count() >= (n_parts or 1)
    found = warc.read_records(archive, warc.lookup(archive, warc.entries(pages)))
    held = found.collect()
    assert Counter(repr(tuple(r[c] for c in COLUMNS)) for r in held) == brute(rows, least_bytes)
    bodies = Counter((r.page_id, bytes(r.payload)) for r in held if r.record_type == "response")
    assert all((html or "").encode() == body for (page_id, body) in bodies for one, _, html in rows if one == page_id and page_id not in (None, 605))
    # The files themselves are sequences of gzip members, which any reader can go through.
    raw = b"".join(gzip.decompress(path.read_bytes()) for path in Path(tmp_path, "warc").iterdir() if path.suffix == ".gz")
    assert raw.count(b"WARC/1.1\r\nWARC-Type: re") == len(rows)
    # A URL, a domain, everything, and nothing.
    keys = {warc.capture_key(url) for _, url, _ in rows}
    for prefix in ("net,example,hot)/ ", "com,example,", "com,example,b)/1", "", "zz", "de,ü)"):
        want = Counter(warc.entry_of(url, page_id) for page_id, url, _ in rows if warc.entry_of(url, page_id).startswith(prefix))
        asked = spark.createDataFrame([(prefix,), (prefix,), (None,)], "prefix string")
        assert Counter(r.entry for r in warc.lookup(archive, asked).collect()) == want, prefix
    urls = warc.entries(pages, whole=False)
    assert {r.prefix[:-1] for r in urls.collect()} == keys
    assert warc.lookup(archive, urls).count() == len(rows)


def test_lookup_reads_few_blocks(spark, tmp_path, monkeypatch):
    rows = [(n, f"http://h{n:05d}.com/", "x") for n in range(5000)]
    archive = warc.write_archive(frame(spark, rows).coalesce(1), str(tmp_path), block_lines=50)
    store, root = warc._store(archive.folder)
    part = archive.parts.orderBy("low").first()
    opened, loaded = warc._Part(store, f"{root}/{part.part}"), []
    load = opened.load
    monkeypatch.setattr(opened, "load", lambda block: loaded.append(block) or load(block))
    assert part.n_blocks > 10 and len(list(opened.find(part.high))) == 1 and len(loaded) <= 2


def test_keys_and_records():
    assert warc.capture_key("HTTP://WWW.Example.com:80/A b?c#d") == "com:80,example,www)/A%20b?c#d"
    assert warc.capture_key(None) == warc.capture_key("") == ")" and warc.capture_key("x y") == ")x%20y"
    assert warc.entry_of("a://b", -(2**63)) < warc.entry_of("a://b", 0) < warc.entry_of("a://b", 2**63 - 1)
    raw = warc.record(4, "http://a/", b"one\r\n\r\ntwo", None)
    assert warc.parse(raw)["payload"] == b"one\r\n\r\ntwo"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"two", b"too"))
    assert warc.parse(warc.record(4, None, b"", 9)) == {"page_id": 4, "url": None, "payload_bytes": 0, "payload_digest": warc.digest_of(b""), "record_type": "revisit", "refers_to": 9, "payload": None}


def test_empty_table(spark, tmp_path):
    pages = frame(spark, [])
    archive = warc.write_archive(pages, str(tmp_path))
    assert archive.parts.count() == 0
    assert warc.read_records(archive, warc.lookup(archive, warc.entries(pages))).count() == 0

"""URL rules and WARC archives."""

import gzip
import hashlib
import io
import random

from helpers import empty
from pyarrow import fs

from corepart.llm import url_rules, warc_chunks
from corepart.store import Store

PAGES = "page_id bigint, url string, html string"


def test_url_rules_against_brute_force(spark):
    rnd = random.Random(3)
    hosts = ["a.com", "b.a.com", "a.b.a.com", "ba.com", "com", "x.net", "", "a..com", "A.Com:80"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/x/y.html", "/de//x", "/en/x?q=/en/", "#/en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "x://\n/en/", "http:///en/"]
    rules = [(rnd.choice(["allow", "block"]), rnd.choice(["a.com", "com", "b.a.com", "net", "A.com"]), rnd.choice(["/", "/en", "/en/", "/en/x/", "", None])) for _ in range(12)]
    rules += [(None, "a.com", "/"), ("block", None, "/")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    for bound in (url_rules.BROADCAST_RULES, 0):
        url_rules.BROADCAST_RULES, kept = bound, url_rules.BROADCAST_RULES
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, table).select("row.page_id", "host", "path", "rule", "verdict").collect()}
        url_rules.BROADCAST_RULES = kept
        for i, url in enumerate(urls):
            host = path = ""
            if url and "://" in url:
                rest = url.split("://", 1)[1]
                at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
                host, rest = rest[:at].lower(), rest[at:]
                path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
            best = None
            for verdict, h, p in rules:
                if verdict is None or h is None or not host:
                    continue
                h, p = h.lower(), p or ""
                if (host == h or host.endswith(f".{h}")) and path.startswith(p):
                    best = max(best or ("",), (len(h + p), len(h), verdict, h + p)) if best else (len(h + p), len(h), verdict, h + p)
            assert got[i] == (host, path, best[3] if best else None, best[2] if best else "allow"), url


def test_urls_that_come_often_are_dealt_to_slots(spark):
    often, long = "http://a.com/en/x", "http://b.a.com/" + "en/" * 40000 + "?q"
    urls = [often] * 50 + [None] * 40 + ["no scheme"] * 5 + [long, long, "http://a.com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rules = spark.createDataFrame([("block", "a.com", "/en/"), ("allow", "b.a.com", "/en/en/")], "verdict string, host string, path string")
    rows = {r.row.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules, slot_rows=4).collect()}
    assert len(rows) == len(urls)
    want = {often: ("a.com/en/", "block"), long: ("b.a.com/en/en/", "allow")}
    assert all(rows[i] == want.get(u, (None, "allow")) for i, u in enumerate(urls))


def test_url_rules_empty_tables_and_clashing_columns(spark):
    rules = spark.createDataFrame(url_rules.RULES, "verdict string, host string, path string")
    assert url_rules.judge_urls(empty(spark, PAGES), rules).count() == 0
    pages = spark.createDataFrame([(1, "http://x.net/es/1", "h"), (1, "http://x.net/es/1", "h"), (None, None, None)], "page_id bigint, url string, host string")
    rows = url_rules.judge_urls(pages, rules).collect()
    assert sorted(r.verdict for r in rows) == ["allow", "block", "block"] and rows[0].row.asDict().keys() == {"page_id", "url", "host"}
    none = url_rules.judge_urls(pages, empty(spark, "verdict string, host string, path string"))
    assert {r.verdict for r in none.collect()} == {"allow"}


def pages(spark):
    big = "".join(chr(0x20 + i % 90) + "é" for i in range(150000))
    rows = [(1, "http://a/1", "x" * 1000), (2, "http://a/2\r\nEvil: 1", "x" * 1000), (3, None, "x" * 999), (4, "u", "x" * 999)]
    rows += [(5, "u", None), (6, "u", ""), (7, "http://ü/", big), (8, "u", big), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 90), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 90)]
    rows += [(None, "u", "n" * 2000), (None, "u", "n" * 2000)]
    return rows, spark.createDataFrame([(*r, "s", 1) for r in rows], f"{PAGES}, record string, size int")


def test_warc_round_trip(spark):
    rows, table = pages(spark)
    store = Store(spark, "test-warc")
    manifest, folder = warc_chunks.archive_pages(table, store)
    read = warc_chunks.read_archives(manifest, folder, chunk=1000).collect()
    assert max(len(r.data) for r in read) <= 1000
    records = {}
    for r in sorted(read, key=lambda r: r.chunk_no):
        records.setdefault(r.record_id, []).append(r)
    assert len(records) == len(rows)
    bodies = {}
    for parts in records.values():
        last = parts[-1]
        assert [p.last for p in parts] == [False] * (len(parts) - 1) + [True]
        body = b"".join(bytes(p.data) for p in parts)
        if last.record_type == "response":
            assert (len(body), hashlib.sha1(body).hexdigest()) == (last.size, last.sha1)
            bodies.setdefault(last.page_id, []).append(body)
        else:
            assert body == b""
    texts = {i: (h or "").encode() for i, _, h in rows}
    assert {k: v for k, v in bodies.items() if k} == {i: [texts[i]] for i in (2, 3, 4, 5, 6, 8, 9)}
    revisits = {p[-1].page_id: p[-1] for p in records.values() if p[-1].record_type == "revisit"}
    assert {k: v.refers_to for k, v in revisits.items()} == {1: 2, 7: 8, 9: 9, None: None}
    assert revisits[7].size == len(texts[7]) and revisits[7].sha1 == hashlib.sha1(texts[7]).hexdigest()
    assert {r.url for r in read if r.page_id == 2} == {"http://a/2%0D%0AEvil: 1"}


def test_warc_members_are_records(spark):
    _, table = pages(spark)
    manifest, folder = warc_chunks.archive_pages(table, Store(spark, "test-warc"))
    for row in manifest.collect():
        files, _ = fs.FileSystem.from_uri(folder)
        with files.open_input_stream(row.archive, compression=None) as raw:
            data = raw.read()
        assert len(data) == row.bytes
        text = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_warc_empty_table(spark):
    manifest, folder = warc_chunks.archive_pages(empty(spark, PAGES), Store(spark, "test-warc"))
    assert manifest.count() == 0 and warc_chunks.read_archives(manifest, folder).count() == 0


def test_chunks_carry_running_digests():
    data = bytes(range(256)) * 10
    rows = list(warc_chunks.split_chunks(iter([data[:5], data[5:2000], data[2000:]]), 100))
    assert b"".join(r[1] for r in rows) == data and [r[0] for r in rows] == list(range(26))
    assert all(r[3] == hashlib.sha1(data[: r[2]]).hexdigest() for r in rows) and rows[-1][4]

"""WARC archives and their index: exact round trips, lookups against brute force, odd rows."""

import gzip
import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from casewright.llm import warc

PAGES = "page_id bigint, url string, html string"


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame(rows, PAGES)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "store")


def whole_archives(folder):
    """All records, reading the archives from end to end without the index."""
    for path in pathlib.Path(folder, "archives").glob("*.warc.gz"):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, rest = data.split(b"\r\n\r\n", 1)
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            yield fields, rest[:size].split(b"\r\n\r\n", 1)[1]
            data = rest[size + 4 :]


@pytest.mark.parametrize("url, key", [
    ("http://www.Example.org/a?b=1#c", "org,example,www)/a?b=1"),
    ("https://u:p@h.net:8080", "net,h:8080)/"),
    ("https://h.net:443?q", "net,h)/?q"),
    ("//h.net/é", "net,h)/é"),
    ("http://[::1]/x", "[::1])/x"),
    ("no url\n", "no%20url%20"),
    ("", ""), (None, ""),
])
def test_keys(spark, url, key):
    row = spark.createDataFrame([(url,)], "url string").select(warc.url_key(F.col("url")).alias("k")).first()
    assert row["k"] == key


def rows_of(n):
    """Pages of several hosts, one of them with a third, with repeated payloads of all sizes."""
    rows = []
    for i in range(n):
        host = "hot.example.com" if i % 3 == 0 else f"h{i % 7}.example.org"
        html = f"<p>page {i % 40 if i % 2 else i}\r\n\r\n é</p>" * (1 if i % 5 else 9)
        rows.append((n - i, f"https://{host}/p/{i % 50}", html))
    return rows


def brute(rows):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = body in first and (i is None or first[body] < i)
        out.append((i, len(body), hashlib.sha256(body).hexdigest(),
                    "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=repr)


def test_round_trip_of_the_query(spark, pages, tmp_path):
    rows = rows_of(300) + [(900, None, "x" * 120), (901, "", None), (902, "odd \r\n url", "x" * 99), (903, "q", "x" * 99)]
    rows += [(None, "http://n/", "x" * 120), (950, "http://é/", "x" * 120), (950, "http://é/", "x" * 120), (5000, "u", "long " * 400_000)]
    pages(rows).write.parquet(f"{tmp_path}/pages.parquet")
    df = warc.op11(spark, str(tmp_path))
    assert df.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == brute(rows)


def test_archives_are_records_from_end_to_end(pages, folder):
    rows = rows_of(120)
    captures = warc.write_archives(pages(rows).repartition(3), folder, archive_bytes=2000)
    found = list(whole_archives(folder))
    assert len(found) == len(rows) == captures.count()
    assert len(list(pathlib.Path(folder, "archives").iterdir())) > 3
    texts = {i: html.encode() for i, _, html in rows}
    for fields, payload in found:
        page = int(fields["WARC-Record-ID"][10:-1])
        assert payload == (texts[page] if fields["WARC-Type"] == "response" else b"")
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(texts[page]).hexdigest()
        if fields["WARC-Type"] == "revisit":
            first = int(fields["WARC-Refers-To"][10:-1])
            assert first < page and texts[first] == texts[page]


def test_lookup_reads_the_wanted_records_only(spark, pages, folder):
    rows = rows_of(400)
    index = warc.archive_pages(pages(rows), folder, block=5)
    assert len(index.parts) <= 4 and index.parts == warc.open_index(spark, folder).parts
    urls = sorted({u for _, u, _ in rows})[::3] + ["https://nowhere/", "", "https://zz.zz/"]
    wanted = spark.createDataFrame([(u,) for u in urls * 2], "url string").select(warc.url_key(F.col("url")).alias("key"))
    records = warc.read_records(index.lookup(wanted), folder).collect()
    want = sorted((i, u) for i, u, _ in rows if u in urls)
    assert sorted((r["page_id"], r["url"]) for r in records) == want
    # Blocks that cannot hold a wanted key are not asked for.
    one = spark.createDataFrame([("com,example,hot)/p/0", 1, 400), ("a", 0, 9), ("zz", 0, 9)], "key string, low bigint, high bigint")
    assert index.blocks(one).count() <= 5
    # A revisit leads to the payload it repeats.
    again = [r for r in records if r["record_type"] == "revisit"][0]
    back = spark.createDataFrame([(again["refers_to_url"], again["refers_to"])], "url string, low bigint").select(
        warc.url_key(F.col("url")).alias("key"), "low", F.col("low").alias("high"))
    first = warc.read_records(index.lookup(back), folder).collect()
    assert [r["page_id"] for r in first] == [again["refers_to"]]
    assert hashlib.sha256(first[0]["payload"]).hexdigest() == again["stated_digest"]


def test_many_equal_keys_span_blocks_and_tasks(spark, pages, folder, monkeypatch):
    rows = [(i % 90, "http://one/", f"page {i}") for i in range(300)] + [(None, None, "n")] * 30
    index = warc.archive_pages(pages(rows), folder, block=4)
    every = spark.createDataFrame([("one)/",), ("",), ("",)], "key string")
    assert index.lookup(every).count() == 330
    some = spark.createDataFrame([("one)/", i, i + 1) for i in range(0, 90, 10)], "key string, low bigint, high bigint")
    assert index.lookup(some).count() == sum(i % 90 % 10 < 2 for i in range(300))
    monkeypatch.setattr(warc, "TURN", 3)
    absent = spark.createDataFrame([(f"one)/{i}",) for i in range(500)], "key string")
    assert index.lookup(absent).count() == 0
    assert index.blocks(absent.selectExpr("key", "0L AS low", "9L AS high")).select("turn").distinct().count() > 20


def test_empty_tables(spark, pages, folder, tmp_path):
    index = warc.archive_pages(pages([]), folder)
    assert index.parts == []
    assert index.lookup(spark.createDataFrame([("a",)], "key string")).count() == 0
    pages([]).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op11(spark, str(tmp_path)).collect() == []


def test_a_damaged_record_is_refused():
    record = warc.record_bytes(1, "u", "d", b"text", None)
    assert warc.parsed(record)["payload"] == b"text"
    with pytest.raises(ValueError):
        warc.parsed(record.replace(b"text", b"tex"))

"""Archives: round trips, the record rules, and the merge against a plain sort."""

import base64
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from gridpulse.llm import queries, warc

HTML = ["<p>same</p>", "<p>other</p>", "", None, "a\r\n\r\nb\r\n\r\n", "WARC/1.1\r\n\r\n", "日本語 😀", "x" * 300_000]


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("run", "at", "place", "time", "n", "first", "size", "check", "sha1", "payload"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def plain(rows, smallest=0):
    first = {}
    for number, _, html in rows:
        if number is not None:
            first[html or ""] = min(number, first.get(html or "", number))
    out = []
    for number, _, html in rows:
        raw = (html or "").encode()
        to = first.get(html or "")
        revisit = to is not None and number != to and len(raw) >= smallest
        out.append((number, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response",
                    to if revisit else None))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_the_whole_table(spark):
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "url", "html").collect()]
    assert found(queries.op11_warc(spark, "/root/testdata/sf0.001")) == plain(rows)


def test_rules_order_and_round_trip(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    urls = ["http://www.example.com/a?b=2&a=1", "https://example.com/a?a=1&b=2#top", "http://example.com:8080/a", "HTTP://EXAMPLE.com", "not a url",
            None, "", "http://[broken", "http://ü.example/ä b\r\nX: 1", "http://example.com/%20%zz"]
    rows = [(None if rng.random() < 0.1 else rng.randrange(150), rng.choice(urls), rng.choice(HTML)) for _ in range(200)]
    rows += [(7, "http://example.com/", "<p>same</p>")] * 3 + [(None, None, "never with an id")] * 2
    monkeypatch.setattr(warc, "RANGE", 40)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    folder, df = f"file://{tmp_path}/archives", pages(spark, rows)
    made = warc.capture_histories(df.repartition(5), folder, time=F.timestamp_seconds(F.col("page_id") % 3)).collect()
    assert found(spark.createDataFrame(made, warc.CAPTURE + ", place long")) == plain(rows)
    made.sort(key=lambda r: r.place)
    order = [(r.url_key, r.time, r.page_id is None, r.page_id or 0, r.archive, r.offset) for r in made]
    assert order == sorted(order) and len({r.place for r in made}) == len(made)
    assert len({r.archive for r in made}) > 5 and len({r.place >> 32 for r in made}) > 2
    body = {}
    for r in warc.read_payloads(spark.createDataFrame(made, warc.CAPTURE + ", place long"), folder).collect():
        if r.payload is not None:
            body.setdefault(r.page_id, set()).add(bytes(r.payload))
    for number, _, html in rows:
        to = next(r[4] for r in plain(rows) if r[0] == number and r[2] == base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode())
        assert (html or "").encode() in body[number if to is None else to]
    for path in (tmp_path / "archives").glob("*.warc.gz"):
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: re")
    assert found(warc.capture_histories(df, smallest=20)) == plain(rows, 20)


def test_url_keys():
    same = {warc.url_key(u) for u in ("http://www.Example.com/a?b=2&a=1", "https://example.com:443/a?a=1&b=2#top", "http://example.com:80/a?a=1&b=2")}
    assert same == {"com,example)/a?a=1&b=2"}
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/" and warc.url_key(None) == "" == warc.url_key("")
    assert warc.url_key("http://[broken") == "http://[broken" and warc.url_key("Plain Words") == "plain words"


def test_loser_tree():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(rng.choices(range(50), k=rng.randrange(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda v: v)) == sorted(v for r in runs for v in r)


def test_a_hot_payload_and_no_rows(spark):
    rows = [(i, f"http://h{i % 3}.example/", "copy" if i % 3 else f"own {i}") for i in range(300)]
    assert found(warc.capture_histories(pages(spark, rows))) == plain(rows)
    assert found(warc.capture_histories(pages(spark, []))) == []


def test_broken_archives_are_refused():
    raw = warc.record(1, "http://a/", "1970-01-01T00:00:00Z", b"body", hashlib.sha1(b"body").digest(), None)
    assert warc.capture("x", 0, 1, raw)[2:8] == (1, "http://a/", 4, base64.b32encode(hashlib.sha1(b"body").digest()).decode(), "response", None)
    for bad in (raw.replace(b"body", b"bady"), raw[:-1]):
        try:
            warc.capture("x", 0, 1, bad)
        except ValueError:
            continue
        raise AssertionError("accepted")

import gzip
import hashlib
import io

from folio.llm import warc as w

PAGES = "page_id long, url string, html string, digest string, key string"
LONG = "<p>" + "é" * 100


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "k") for r in rows], PAGES)


ROWS = [(3, "http://b.example.com/x?y#z", LONG), (1, "http://a.example.com/", LONG), (2, None, LONG), (4, "http://x.org/\r\nX: y", "short"), (5, "u", "short"), (6, "", None), (None, "http://x.org", LONG), (7, "http://a.example.com/", "z" * 99), (8, "http://a.example.com/", "z" * 99), (9, "q", "y" * 300_000)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        if h is not None and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = first.get(h) if first.get(h) != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [*ROWS, ROWS[0], ROWS[1]]
    got = sorted((tuple(r) for r in w.round_trip(table(spark, rows)).collect()), key=str)
    assert got == expected(rows)
    assert w.round_trip(table(spark, ROWS).limit(0)).count() == 0


def test_lookup_reads_the_blocks_that_hold_the_key(spark):
    rows = [(i, f"http://h{i % 7}.example.org/p{i}", f"body {i}") for i in range(200)] + [(1000 + i, "http://same.example.org/", f"copy {i}") for i in range(30)]
    archive = w.write(table(spark, rows), block_lines=8)
    assert archive.directory.count() >= 29
    found = {r.page_id: r.payload for r in w.lookup(archive, ["http://h3.example.org/p3", "http://h0.example.org/none", "HTTP://H5.example.org/p5#f"]).collect()}
    assert found == {3: "body 3", 5: "body 5"}
    assert w.lookup(w.open_archive(spark, archive.folder), ["http://same.example.org"]).count() == 30
    assert w.lookup(archive, []).count() == 0


def test_keys_and_records():
    assert w.url_key("http://user@WWW.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b" and w.url_key(None) == "" and w.url_key("http://x") == "x)/"
    data = w.member(w.record(1, "http://x/\n", b"body", "d", None, False))
    own, http, payload = w.read_record(gzip.GzipFile(fileobj=io.BytesIO(data)).read())
    assert (own["warc-target-uri"], http["content-length"], payload) == ("http://x/%0A", "4", b"body")

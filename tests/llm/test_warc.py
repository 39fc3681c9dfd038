import base64
import hashlib

from cascata.llm import warc


def brute(rows, least=0):
    first = {}
    for i, html in rows:
        raw = (html or "").encode()
        if len(raw) >= least and i is not None:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, html in rows:
        raw = (html or "").encode()
        to = first.get(raw)
        again = len(raw) >= least and to is not None and to != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def odd_pages():
    long = "<p>é</p>" * 30000
    return [(1, "a"), (2, "a"), (3, ""), (4, None), (5, long), (6, long), (7, "a"), (7, "a"), (1, "a"), (None, "a"), (None, "solo"), (8, "x\r\n\r\ny\n\n"), (9, "WARC/1.1\r\n\r\n")] + [(100 + k, f"page {k % 9}") for k in range(60)]


def test_round_trip_against_brute_force(spark):
    rows = odd_pages()
    pages = spark.createDataFrame([(i, "http://h/\n" if i == 2 else None, h, "clash", 3) for i, h in rows], "page_id long, url string, html string, payload_digest string, first int")
    for least in (0, 2):
        records = warc.read_archives(warc.archive(pages, min_bytes=least))
        assert sorted(map(tuple, warc.verify_records(records).collect()), key=str) == brute(rows, least)
        assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in records.collect())
    assert warc.verify_records(warc.read_archives(warc.archive(pages.limit(0)))).count() == 0


def test_archives_are_cut_and_complete(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"{k}" * 400) for k in range(50)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(warc.resolve(pages), folder, archive_bytes=2000)
    assert manifest.count() == 50
    names = warc.local_files(folder)
    assert len(names) > 5 and not any(n.startswith(".") for n in names)


def test_attempts_in_different_orders_do_not_mix(spark, tmp_path):
    rows = [(k, "u", f"page {k % 4} " * 30) for k in range(20)]
    schema, folder = "page_id long, url string, html string", f"file://{tmp_path}/warc"
    for order in (rows, rows[::-1]):
        resolved = warc.resolve(spark.createDataFrame(order, schema)).coalesce(1)
        manifest = spark.createDataFrame(warc.write_archives(resolved.orderBy("page_id") if order is rows else resolved.orderBy("payload", "page_id"), folder).collect(), warc.MANIFEST)
        got = sorted(map(tuple, warc.verify_records(warc.read_archives(manifest)).collect()), key=str)
        assert got == brute([(i, h) for i, _, h in rows])


def test_fresh_headers():
    data = warc.record(7, "http://a/\nb", b"<p>", "D", "revisit", 3, "http://c/", "2020-01-01T00:00:00Z")
    for line in (b"WARC-Refers-To: <urn:page:3>", b"WARC-Refers-To-Target-URI: http://c/", b"WARC-Target-URI: http://a/ b", b"WARC-Date: 2020-01-01T00:00:00Z"):
        assert line in data
    assert warc.warcinfo("2020-01-01T00:00:00Z").startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_a_revisit_without_its_response(spark):
    records = spark.createDataFrame([(2, "revisit", "u", "D", 5, 1, None)], warc.RECORDS)
    assert tuple(warc.verify_records(records).first()) == (2, None, None, "revisit", 1)

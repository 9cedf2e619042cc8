import base64
import hashlib
import io
import zlib


from strandlake.llm.warc import Range, _Stream, gzip_member, page_records, page_rows, read_range, read_warc, record, write_warc

PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2 x\r\nInjected: yes", "<p>zwei ü</p>"), (3, None, "<p>one</p>"), (4, "u", None), (5, "u", ""), (6, "u", "x" * 300_000),
         (7, "http://a/7", "<p>one</p>"), (8, "u", "WARC/1.1\r\n\r\nWARC-Type: fake\r\n\r\n"), (None, "n", "null id"), (9, "u", "seven"), (9, "u", "seven")]


def expected(pages, least=0):
    data = [(p, (h or "").encode()) for p, _, h in pages]
    out = []
    for p, payload in data:
        same = [q for q, x in data if x == payload and q is not None]
        first = max(same, default=None)
        revisit = len(payload) >= least and p != first and len([1 for _, x in data if x == payload]) > 1
        out.append((p, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def frame(spark, pages):
    return spark.createDataFrame([(p, u, h, "extra") for p, u, h in pages], "page_id long, url string, html string, payload string")


def test_round_trip(spark, tmp_path):
    for name, options in (("gz", {"maxBytes": 2000}), ("plain", {"compression": "none"})):
        path = str(tmp_path / name)
        write_warc(page_records(frame(spark, PAGES)), path, **options)
        for split in (64 << 20, 500):
            got = page_rows(read_warc(spark, path, splitBytes=split)).collect()
            assert sorted(map(tuple, got), key=str) == expected(PAGES)
        html = {r["record_id"]: r["payload"] for r in read_warc(spark, path).filter("record_type = 'response'").collect()}
        assert bytes(html["<urn:page:6>"]) == b"x" * 300_000 and bytes(html["<urn:page:2>"]) == "<p>zwei ü</p>".encode()
        assert not [f for f in (tmp_path / name).iterdir() if f.name == "_temporary" and any(f.iterdir())]


def test_small_payloads_are_all_responses(spark, tmp_path):
    write_warc(page_records(frame(spark, PAGES), least=8), str(tmp_path / "w"))
    assert sorted(map(tuple, page_rows(read_warc(spark, str(tmp_path / "w"))).collect()), key=str) == expected(PAGES, 8)


def test_predicates_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "w")
    write_warc(page_records(frame(spark, PAGES)), path)
    archive = read_warc(spark, path)
    some = archive.filter("record_type = 'revisit' and record_id in ('<urn:page:1>', '<urn:page:2>') and date is not null")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "+- Filter" not in plan and ") Filter" not in plan
    assert [r["record_id"] for r in some.collect()] == ["<urn:page:1>"]
    assert archive.filter(archive.target_uri.startswith("http://a/")).count() == 3
    assert archive.filter("target_uri is null").count() == 1
    assert archive.filter("payload_digest is not null and http_length > 1000").count() == 1
    assert {r["payload"] for r in read_warc(spark, path, payload="false").collect()} == {None}


def test_skipping_does_not_inflate(tmp_path):
    rows = [{"record_type": "response", "record_id": f"<urn:page:{k}>", "target_uri": "u", "date": "d", "refers_to": None, "payload": bytes([k]) * 100_000} for k in range(5)]
    data = b"".join(gzip_member(record(r)) for r in rows)
    inflated = []

    class Counting(_Stream):
        def more(self):
            piece = super().more()
            inflated.append(len(piece))
            return piece

    import strandlake.llm.warc as warc
    plain, warc._Stream = warc._Stream, Counting
    try:
        part = Range("x.warc.gz", 0, len(data))
        got = list(read_range(io.BytesIO(data), len(data), part, [("in", "record_id", ("<urn:page:3>",))], True))
        assert [r[1] for r in got] == ["<urn:page:3>"] and len(inflated) <= 2 * 5
        unmarked = b"".join(zlib_member(record(r)) for r in rows)
        got = list(read_range(io.BytesIO(unmarked), len(unmarked), Range("x.warc.gz", 0, len(unmarked)), [("in", "record_id", ("<urn:page:3>",))], True))
        assert [r[1] for r in got] == ["<urn:page:3>"]
    finally:
        warc._Stream = plain


def zlib_member(data):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def test_every_split_finds_each_record_once():
    rows = [{"record_type": "response", "record_id": f"<urn:page:{k}>", "target_uri": "u", "date": "d", "refers_to": None, "payload": b"ab" * k} for k in range(40)]
    data = b"".join(gzip_member(record(r)) for r in rows)
    for step in (1, 37, 1000):
        got = [r[1] for at in range(0, len(data), step) for r in read_range(io.BytesIO(data), len(data), Range("x.warc.gz", at, min(at + step, len(data))), [], False)]
        assert got == [f"<urn:page:{k}>" for k in range(40)]


def test_empty_table(spark, tmp_path):
    write_warc(page_records(frame(spark, [])), str(tmp_path / "w"))
    assert page_rows(read_warc(spark, str(tmp_path / "w"))).collect() == []

"""The converter's round trip, its parsers' refusals and its rows."""

import base64
import glob
import gzip
import hashlib

import pytest

from cinderframe.llm import arc

PAGES = [(k, f"http://h{k % 3}.org/a b{k}", ("<p>é%d</p>\r\n\r\n" % (k % 7)) * 200) for k in range(40)]
PAGES += [(50, None, None), (51, "", ""), (52, "u", "short"), (53, "v", "short"), (54, "w", "x" * 999), (55, "w", "x" * 999), (56, "w", "y" * 1000), (57, "w", "y" * 1000), (58, "z", "line\n" * 100_000)]
PAGES += [(None, "gone", "y" * 1000)]
SCHEMA = "page_id long, url string, html string, digest string, refers_to long"


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], SCHEMA).repartition(3)
    got = {r.page_id: r for r in arc.through_archives(df).collect()}
    rows = [(i, (h or "").encode()) for i, _, h in PAGES]
    assert len(got) == len(rows) == arc.through_archives(df).count()
    for i, payload in rows:
        best = max((j for j, p in rows if p == payload and j is not None), default=None)
        revisit = len(payload) >= 1000 and best != i and i is not None
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", best) if revisit else ("response", None))
    assert arc.through_archives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows(spark):
    rows = [(1, "a", "p" * 2000), (1, "a", "p" * 2000), (2, "b", "p" * 2000)]
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in arc.through_archives(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "revisit", 2), (1, "revisit", 2), (2, "response", None)]


@pytest.mark.parametrize("version", [b"1", b"2"])
def test_versions(version):
    data = arc.version_block(version) + b"\n" + arc.arc_record(5, "http://x/", "body\n\n", version) + b"\n"
    info, (page, kind, origin, uri, date, media, http, payload) = arc.read_arc(data, "a.arc")
    assert (info[1], info[2]) == ("warcinfo", "a.arc:0")
    assert (page, kind, uri, date, media, payload) == (5, "response", "http://x/", arc.DATE, "text/html", b"body\n\n")
    (field, block), = arc.read_warc(arc.warc_record(page, kind, origin, uri, date, media, http, payload) + arc.BREAK)
    assert field["WARC-Date"] == "2024-01-01T00:00:00Z" and arc.warc_row(field, block)[:2] == (5, 6)
    with pytest.raises(ValueError):
        list(arc.read_arc(data[:-5]))
    with pytest.raises(ValueError):
        list(arc.read_arc(arc.version_block(b"1") + b"\n" + arc.arc_record(5, "u", "b", b"2")))


DNS = b"20030102030405\nexample.org. 3600 IN A 10.0.0.1\n"


def foreign(version):
    """An archive as others write it: no page ids, dns and ftp records, bytes that are no text, header lines with CR LF."""
    fields = b"URL IP-address Archive-date Content-type " + (b"Result-code Checksum Location Offset Filename " if version == b"2" else b"") + b"Archive-length"
    more = b"200 abc - 17 other.arc " if version == b"2" else b""
    block = version + b" 0 SomeCrawler\n" + fields + b"\n\n"
    bodies = [
        (b"dns:example.org", b"text/dns", DNS),
        (b"http://example.org/", b"text/html", b"HTTP/1.0 200 OK\r\nServer: old\r\n\r\n<p>\xff\xfe raw</p>" + b"z" * 3_000_000),
        (b"http://example.org/lf", b"text/html", b"HTTP/1.0 200 OK\nServer: older\n\n<p>line feeds</p>"),
        (b"ftp://example.org/a.bin", b"application/octet-stream", bytes(range(256)) * 8),
        (b"http://example.org/empty", b"no-type", b""),
    ]
    out = b"filedesc://other.arc 0.0.0.0 20030102030405 text/plain " + more + b"%d\n" % len(block) + block + b"\n"
    for uri, media, body in bodies:
        out += uri + b" 10.0.0.1 20030102030405 " + media + b" " + more + b"%d\n" % len(body) + body + b"\n"
    return out


@pytest.mark.parametrize("version", [b"1", b"2"])
def test_foreign_archives(spark, tmp_path, version):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/plain.arc").write_bytes(foreign(version))
    members = foreign(version).split(b"\nhttp://example.org/lf", 1)
    (tmp_path / "in/packed.arc.gz").write_bytes(gzip.compress(members[0] + b"\n") + gzip.compress(b"http://example.org/lf" + members[1]))
    rows = arc.arc_rows(spark, f"{tmp_path}/in").collect()
    assert len(rows) == 12 and len({r.origin for r in rows}) == 12 and {r.page_id for r in rows} == {None}
    assert sorted(r.kind for r in rows) == ["resource"] * 4 + ["response"] * 6 + ["warcinfo"] * 2
    out = arc.convert(spark, f"{tmp_path}/in")
    found = []
    for f in glob.glob(f"{out.removeprefix('file:')}/*.gz"):
        found += list(arc.read_warc(open(f, "rb").read()))
    assert len({f["WARC-Record-ID"] for f, _ in found}) == 12
    kinds = {(f["WARC-Type"], f["Content-Type"]) for f, _ in found}
    assert kinds == {("warcinfo", "application/warc-fields"), ("response", "text/dns"), ("response", "application/http; msgtype=response"), ("resource", "application/octet-stream"), ("resource", "no-type")}
    for field, block in found:
        assert field["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() and field["WARC-Date"] == "2003-01-02T03:04:05Z"
    got = sorted((r.payload_bytes, r.record_type, r.refers_to) for r in arc.warc_rows(spark, out).collect())
    assert got == sorted([(len(DNS), "response", None), (3_000_013, "response", None), (17, "response", None), (2048, "resource", None), (0, "resource", None)] * 2)


def test_bad_input():
    for bad in (b"http://x 0.0.0.0 1 text/html ten\n", b"http://x 0.0.0.0 20240101000000 text/html 3\nabc\n", b"filedesc://x 0.0.0.0 1 text/plain 4\n9 0 \n"):
        with pytest.raises(ValueError):
            list(arc.read_arc(bad))
    with pytest.raises(ValueError):
        list(arc.read_warc(b"no header\r\n\r\n"))
    assert list(arc.read_arc(b"")) == list(arc.read_warc(b"")) == []

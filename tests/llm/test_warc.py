"""WARC archives: round trip, revisits, and what the reader saves from damage."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lumenscan.llm import warc

PAGES = "page_id bigint, url string, html string, digest string, payload int"
LARGE = "<p>" + "x" * 1000


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in rows], PAGES).repartition(3)


def expected(rows):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == payload and j is not None]
        first = max(same) if len(payload) >= 1000 and same else i
        again = i != first
        out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [
        (1, "http://a/", LARGE), (5, "http://b/\r\nX: y", LARGE), (3, None, LARGE), (None, "u", LARGE), (9, "u", "short"), (2, "u", "short"),
        (4, "u", None), (6, "u", ""), (7, "ü/日", "WARC/1.1\r\n\r\nbody é\x00"), (8, "u", LARGE + "é"), (10, "u", LARGE + "é"), (8, "u", LARGE + "é"),
        (11, "u", "y" * 3_000_000),
    ]
    got = warc.page_records(pages_of(spark, rows)).drop("url").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_no_pages(spark):
    assert warc.page_records(pages_of(spark, []).limit(0)).collect() == []


def test_urls_come_back(spark):
    got = warc.page_records(pages_of(spark, [(1, "http://ü/?a=b:c", "z"), (2, None, "z")])).orderBy("page_id").collect()
    assert [r.url for r in got] == ["http://ü/?a=b:c", None]


RECORDS = [warc.record("response", f"urn:page:{i}", "u", None, "d", 9, f"payload {i}".encode()) for i in range(5)]


def read(data):
    good, gaps, place = [], [], 0
    for offset, length, headers, block, reason in warc.salvage(data):
        assert offset >= place
        place = offset + (length if headers is None else 0)
        good.append(block) if headers is not None else gaps.append((offset, length, reason))
    return good, gaps


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_goes_on_behind_damage(packed):
    parts = [warc.member(r) if packed else r for r in RECORDS]
    whole = b"".join(parts)
    assert read(whole) == ([f"payload {i}".encode() for i in range(5)], [])
    for broken in (1, 3):
        at = sum(map(len, parts[:broken])) + len(parts[broken]) - (12 if packed else 8)
        damaged = bytearray(whole)
        damaged[at] ^= 255
        good, gaps = read(bytes(damaged))
        assert good == [f"payload {i}".encode() for i in range(5) if i != broken]
        assert [(o, n) for o, n, _ in gaps] == [(sum(map(len, parts[:broken])), len(parts[broken]))]


@pytest.mark.parametrize("packed", [True, False])
def test_junk_truncation_and_lost_bytes(packed):
    parts = [warc.member(r) if packed else r for r in RECORDS]
    junk = b"\x1f\x8b\x08 not a member" if packed else b"WARC/1.1\r\nno colon\r\n\r\n"
    good, gaps = read(parts[0] + junk + parts[1] + parts[2][: len(parts[2]) // 2])
    assert good == [b"payload 0", b"payload 1"]
    assert [(o, n) for o, n, _ in gaps] == [(len(parts[0]), len(junk)), (len(parts[0] + junk + parts[1]), len(parts[2]) // 2)]
    assert read(b"") == ([], [])
    good, gaps = read(b"nothing to find")
    assert good == [] and gaps[0][:2] == (0, 15)


def test_archives_are_plain_gzip(spark, tmp_path):
    warc.write_archives(pages_of(spark, [(i, "u", f"text {i}") for i in range(20)]), str(tmp_path / "a"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "a").glob("part-*"))
    assert text.count(b"WARC/1.1\r\n") == 20
    assert {len(list(warc.salvage(p.read_bytes()))) for p in (tmp_path / "a").glob("part-*")} <= set(range(21))


def test_reader_logs_gaps(spark, tmp_path):
    (tmp_path / "part-1.warc.gz").write_bytes(warc.member(RECORDS[0]) + b"dirt" + warc.member(RECORDS[1]))
    (tmp_path / "part-2.warc").write_bytes(RECORDS[2] + b"dirt" + RECORDS[3])
    (tmp_path / "part-3.warc").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.payload for r in rows if r.kind == "record") == [b"payload 0", b"payload 1", b"payload 2", b"payload 3"]
    assert [(r.length, bool(r.reason)) for r in rows if r.kind == "gap"] == [(4, True), (4, True)]


def foreign(digest, body=b"<p>hello"):
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Block-Digest: " + digest + b"\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    sha1 = hashlib.sha1(b"<p>hello")
    base32 = base64.b32encode(sha1.digest())
    forms = [b"sha1:" + base32, b"sha1:" + base32.lower(), b"SHA1:" + sha1.hexdigest().upper().encode(), b"md5:0123", b"sha1:?"]
    (tmp_path / "below").mkdir()
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(foreign(f)) for f in forms))
    (tmp_path / "below" / "y.warc").write_bytes(foreign(forms[0]))
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.file.rsplit("/", 1)[-1], r.kind) for r in rows) == [("x.warc.gz", "record")] * 5 + [("y.warc", "record")]
    assert warc.read_archives(spark, str(tmp_path), "*.warc").count() == 1


@pytest.mark.parametrize("form", [base64.b32encode(bytes(20)), b"0" * 40])
def test_wrong_digests_of_any_form_are_gaps(form):
    assert [x[4] for x in warc.salvage(foreign(b"sha1:" + form))] == ["the block's digest differs"]


def test_records_around_damage_in_a_member_stay():
    sound, bad = foreign(b"md5:0"), foreign(b"sha1:" + b"0" * 40, b"bad")
    packed = gzip.compress(sound + bad + sound) + gzip.compress(sound)
    found = [(headers is not None, block, reason) for _, _, headers, block, reason in warc.salvage(packed)]
    good = (True, b"<p>hello", None)
    assert found == [good, good, (False, b"", "the block's digest differs"), good]


def test_archives_are_rolled_by_size(spark, tmp_path, monkeypatch):
    """However few the tasks, an archive has ROWS_PER_ARCHIVE rows at most, and all pages come back."""
    monkeypatch.setattr(warc, "_ROW_BYTES", 4000)
    monkeypatch.setattr(warc, "ROWS_PER_ARCHIVE", 2)
    rows = [(i, f"http://a/{i}", f"{i} " + "y" * 1500) for i in range(40)]
    warc.write_archives(pages_of(spark, rows).coalesce(1), str(tmp_path / "a"))
    sizes = [r["n"] for r in warc.read_archives(spark, str(tmp_path / "a")).groupBy("file").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 40 and len(sizes) >= 7 and max(sizes) <= 6
    assert warc.whole_records(warc.read_archives(spark, str(tmp_path / "a"), "part-*")).count() == 40


def test_a_gap_in_own_archives_stops_the_job(spark, tmp_path):
    warc.write_archives(pages_of(spark, [(i, "u", f"text {i}") for i in range(8)]).coalesce(1), str(tmp_path / "a"))
    part = next((tmp_path / "a").glob("part-*"))
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 255
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / part.name).write_bytes(data)
    with pytest.raises(Exception, match="damaged archive"):
        warc.whole_records(warc.read_archives(spark, str(tmp_path / "b"), "part-*")).collect()

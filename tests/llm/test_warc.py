import hashlib

import pytest

from tools.check_queries import compare, connect
from veriscope.llm import warc

BIG = "<p>" + "same text " * 20 + "</p>"
ROWS = [
    (3, "http://a/3", BIG), (1, "http://a/1", BIG), (2, None, BIG), (5, "http://a/5", "small"), (4, "http://a/4", "small"),
    (6, "http://a/6", None), (7, "http://a/7", ""), (8, "http://a/8\r\nX: y", "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9),
    (9, "http://a/9", "é😀\x00" * 100), (9, "http://a/9", "é😀\x00" * 100), (10, "http://a/10", "x" * 300_000), (None, "http://a/n", "y" * 200),
    (11, "http://a/11", "y" * 200), (1, "http://a/other", BIG),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "archives")
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS digest")
    warc.write_archives(df.repartition(3), path)
    return path


def test_round_trip(spark, folder):
    got = warc.assembled(warc.read_records(spark, folder)).collect()
    assert len(got) == len(ROWS)
    full = sorted((r.metadata.page_id or -1, r.capture.payload.decode()) for r in got if r.capture.type == "response")
    want = [(i or -1, h or "") for i, _, h in ROWS if not (i in (2, 3) or (i is None))]
    assert full == sorted(want)
    for r in got:
        assert r.request is not None and r.metadata is not None
        if r.capture.type == "response":
            assert r.capture.payload_digest == r.capture.declared_digest == hashlib.sha256(r.capture.payload).hexdigest()
            assert r.original is None
        else:
            assert r.capture.payload is None and r.original.payload_digest == r.capture.declared_digest
    revisits = {r.metadata.page_id: r.original.page_id for r in got if r.capture.type == "revisit"}
    assert revisits == {2: 1, 3: 1, None: 11}
    assert {r.capture.target_uri for r in got if r.metadata.page_id == 2} == {None}


def test_archives_are_warc_files(folder):
    """Read by the format's rules alone: lines of headers, an empty line, a block, two empty lines."""
    import glob

    kinds = []
    for name in glob.glob(f"{folder}/part-*"):
        data = open(name, "rb").read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            assert rest[size:size + 4] == b"\r\n\r\n"
            data = rest[size + 4:]
            kinds.append(fields[b"WARC-Type"])
    assert len(kinds) == 3 * len(ROWS) and kinds.count(b"request") == len(ROWS)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "none"))
    assert warc.assembled(warc.read_records(spark, str(tmp_path / "none"))).count() == 0


def test_query_equals_sql(spark, sf_dir):
    assert compare("op10", warc.op10_warc(spark, sf_dir), connect(sf_dir), warc.ORACLE).startswith("ok (")


def test_archives_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    import glob
    import os

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    monkeypatch.setattr(warc, "CLASS_BYTES", 1_000)
    pages = [(i, f"http://{i}", f"{i} " + "x" * (50 if i < 900 else 60_000 if i < 910 else 150_000)) for i in range(912)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"))
    sizes = [os.path.getsize(f) for f in glob.glob(str(tmp_path / "a" / "part-*"))]
    assert max(sizes) < 152_000 and len(sizes) < 30
    got = warc.assembled(warc.read_records(spark, str(tmp_path / "a"))).collect()
    assert sorted((r.metadata.page_id, r.capture.payload.decode()) for r in got) == [(i, h) for i, _, h in pages]


def test_cut_archives_are_refused():
    whole = b"WARC/1.1\r\nWARC-Record-ID: a\r\nWARC-Type: request\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert len(list(warc.parsed_records(memoryview(whole), True))) == 1
    for end in (31, len(whole) - 6):
        with pytest.raises(ValueError):
            list(warc.parsed_records(memoryview(whole[:end]), True))

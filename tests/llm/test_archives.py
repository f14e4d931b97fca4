import io
from collections import defaultdict

import pytest

from plumbline.llm import archives as A

SCHEMA = "page_id bigint, url string, html string, name string"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    r = A.ArcRecord("http://a/ b\nc é".encode(), b"1.2.3.4", "20200102030405", b"text/html", b"HTTP/1.1 200 OK\r\n\r\nx\n\ny")
    assert A.arc_version(A.arc_header(version, "f.arc")) == version
    back = A.parse_arc(A.arc_record(version, r, 7, "f.arc"), version)
    assert (back.url, back.ip, back.date, back.body) == ("http://a/%20b%0Ac%20é".encode(), r.ip, r.date, r.body)
    with pytest.raises(A.ArchiveError):
        A.parse_arc(A.arc_record(version, r, 7, "f.arc")[:-9], version)


def test_unknown_version():
    with pytest.raises(A.ArchiveError):
        A.arc_version(b"filedesc://x 0.0.0.0 20200101000000 text/plain 9\n3 0 x\nURL\n")


def test_members_across_chunks():
    raw = [b"a" * 5, b"", bytes(range(256)) * 40]
    packed = b"".join(map(A.pack_member, raw))
    got = list(A.members(io.BytesIO(packed), 7))
    assert [g[2] for g in got] == raw
    assert [packed[o : o + n] for o, n, _ in got] == list(map(A.pack_member, raw))
    with pytest.raises(A.ArchiveError):
        list(A.members(io.BytesIO(packed[:-3]), 7))


def test_dates():
    assert A.warc_date("20200102030405") == "2020-01-02T03:04:05Z"
    assert A.warc_date("202001020304") == "2020-01-02T03:04:00Z"


def expected(rows):
    by = defaultdict(list)
    for page, html in rows:
        by[(html or "").encode()].append(page)
    out = []
    for payload, pages in by.items():
        top = max(pages, key=lambda p: (p is not None, p))
        taken = False
        for p in pages:
            first = p == top and not taken
            taken |= first
            out.append((p, len(payload), A.digest(payload), "response" if first else "revisit", None if first else top))
    return sorted(out, key=repr)


def test_pages(spark):
    rows = [(1, "x"), (2, "x"), (3, "é" * 5), (4, None), (5, ""), (6, "x\r\n\r\nWARC/1.1"), (7, "x"), (7, "x"), (None, "y"), (None, "y"), (8, "long " * 50_000)]
    df = spark.createDataFrame([(p, None if p == 3 else f"http://h/{p} z", h, "clash") for p, h in rows], SCHEMA)
    assert sorted((tuple(r) for r in A.archive_pages(df).collect()), key=repr) == expected(rows)


def test_hot_payload_and_minimum(spark):
    rows = [(i, "same" if i % 3 == 0 else f"p{i // 2}") for i in range(3000)]
    df = spark.createDataFrame([(p, "u", h, "") for p, h in rows], SCHEMA)
    assert sorted((tuple(r) for r in A.archive_pages(df).collect()), key=repr) == expected(rows)
    assert {r.record_type for r in A.archive_pages(df, least=100).collect()} == {"response"}


def test_no_pages(spark):
    assert A.archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("kind", ["string", "smallint", "int"])
def test_ids_of_other_types(spark, kind):
    make = (lambda i: f"é {i}\r\n:") if kind == "string" else int
    rows = [(make(1), "x"), (make(2), "x"), (make(3), None), (None, "z"), (None, "z")] + ([("", "x"), ("", "q")] if kind == "string" else [])
    got = A.archive_pages(spark.createDataFrame([(p, "u", h) for p, h in rows], f"page_id {kind}, url string, html string"))
    assert got.schema["page_id"].dataType == got.schema["refers_to"].dataType and got.dtypes[0][1] == kind
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)

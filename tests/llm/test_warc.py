import base64
import gzip
import hashlib

import pytest

from tidewright.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string, n long"


def digest(s):
    return base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def rows():
    long = "é<p>\r\n\r\nWARC/1.1\r\n" * 30_000
    return [(5, "http://a/\r\nX: y", "same", "x", 1), (2, "http://b", "same", "x", 1), (9, None, "same", "x", 1), (3, "http://c", None, "x", 1), (4, "http://d", "", "x", 1), (6, "http://e", long, "x", 1), (7, "http://f", "\r\n\r\n", "x", None), (None, "http://g", "same", None, None), (8, "http://h", "own", None, None)]


def expected(rows, least=0):
    first = {}
    for page, _, html, *_ in rows:
        if page is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html, *_ in rows:
        head = first.get(html or "") if page is not None else None
        again = head is not None and head != page
        out.append((page, len((html or "").encode()), digest(html), "revisit" if again else "response", head if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, rows, least, compression):
    df = spark.createDataFrame(rows, SCHEMA)
    out = W.archive_and_resolve(df, f"file://{tmp_path}/w", least_bytes=least, compression=compression)
    assert sorted(map(tuple, out.collect()), key=str) == expected(rows, least)
    texts = sorted(x["payload"] for x in W.read_archives(spark, f"file://{tmp_path}/w", payloads=True, compression=compression).collect() if x["record_type"] == "response")
    assert set(texts) == {html or "" for _, _, html, *_ in rows}


def test_archives_are_records_in_a_row(spark, tmp_path, rows):
    W.write_archives(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/w", date="2024-01-01T00:00:00Z")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    found = list(W.parse(iter([raw])))
    assert len(found) == len(rows)
    assert {h["warc-type"] for h, _ in found} == {"response", "revisit"}
    assert all(b == b"" and h["warc-profile"] == W.PROFILE and h["warc-refers-to"] for h, b in found if h["warc-type"] == "revisit")
    assert list(W.parse(raw[k : k + 7] for k in range(0, len(raw), 7))) == found
    assert "http://a/  X: y" in {h.get("warc-target-uri") for h, _ in found}


def test_damage_is_an_error():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert len(list(W.parse(iter([good * 2])))) == 2
    for bad in (good[:-6], good + b"WARC/1.1\r\nCont", b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(W.parse(iter([bad])))


@pytest.mark.parametrize("broadcast", [0, 100])
def test_hot_payload_and_repeated_rows(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(W, "BROADCAST_KEYS", broadcast)
    rows = [(k, f"http://{k}", "hot" if k % 3 else f"own {k % 20}", None, None) for k in range(120)] + [(1, "http://1", "hot", None, None), (1, "http://1", "else", None, None), (2, "http://2", "hot", None, None)]
    out = W.archive_and_resolve(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/w")
    assert sorted(map(tuple, out.collect()), key=str) == expected(rows)
    found = W.read_archives(spark, f"file://{tmp_path}/w").where("record_type = 'response'")
    assert found.count() == len({html for _, _, html, *_ in rows}) + 1


def test_a_lost_response_leaves_nulls(spark, tmp_path):
    W.write_archives(spark.createDataFrame([(1, "a", "x", None, None), (2, "b", "x", None, None)], SCHEMA), f"file://{tmp_path}/w")
    out = W.resolve(W.read_archives(spark, f"file://{tmp_path}/w").where("record_type = 'revisit'")).collect()
    assert [(r["page_id"], r["payload_bytes"], r["refers_to"]) for r in out] == [(2, None, None)]


def test_empty_table(spark, tmp_path):
    assert W.archive_and_resolve(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w").count() == 0

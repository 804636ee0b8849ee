import base64
import gzip
import hashlib

import pytest
from coratings.llm import warc
from coratings.llm.staging import folder


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if page is not None and len(payload) >= least:
            first[payload] = min(page, first.get(payload, page))
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        refers = first.get(payload)
        kind = "response" if refers is None or refers == page else "revisit"
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, kind, refers if kind == "revisit" else None))
    return sorted(out, key=str)


ROWS = [
    (3, "http://a/", "<p>é</p>"), (2, "http://b/ x\r\n", "<p>é</p>"), (9, None, None), (4, "u", ""), (5, "u", "a\r\n\r\nb"),
    (6, "u", "long " * 50_000), (7, "u", "long " * 50_000), (None, "u", "<p>é</p>"), (None, "u", "only"), (None, "v", "only"), (2, "w", "<p>é</p>"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "READ", 400)
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, refers_to string").repartition(3)
    got = sorted((tuple(r) for r in warc.archived(pages, least).collect()), key=str)
    assert got == expected(ROWS, least)


def test_test_tables(spark, sf_check):
    pages = spark.read.parquet(f"{sf_check}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in warc.archived(pages).collect()), key=str) == expected(rows)


def test_chosen_records_and_files(spark, monkeypatch):
    """Archives are whole gzip members, and chosen rows of the index are read alone."""
    monkeypatch.setattr(warc, "ARCHIVE", 2000)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    where = folder(spark)
    index = warc.write_archives(pages, where)
    assert index.select("file").distinct().count() > 1
    files, root = warc._filesystem(where)
    for row in index.collect():
        with files.open_input_file(f"{root}/{row.file}") as f:
            raw = gzip.decompress(f.read_at(row.length, row.offset))
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
        assert warc.parse(raw)["payload_digest"] == row.payload_digest
    some = warc.read_records(index.where("url = 'u' AND record_type = 'response'"), where, with_payload=True).collect()
    assert sorted(bytes(r.payload).decode() for r in some) == sorted(["", "a\r\n\r\nb", "long " * 50_000, "only"])


def test_archives_are_read_by_as_many_tasks_as_their_bytes_ask_for(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK", 3000)
    pages = spark.createDataFrame([(k, "u", f"{k} " * 2000 + str(hash(str(k)))) for k in range(300)], "page_id long, url string, html string")
    where = folder(spark)
    index = warc.write_archives(pages.coalesce(1), where)
    read = warc.read_records(index, where)
    assert read.rdd.getNumPartitions() > 4 and index.select("file").distinct().count() == 1
    assert read.select("page_id").distinct().count() == 300


def test_damage_is_noticed():
    raw, _ = warc.record(1, "0", "u", b"payload", None)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(raw.replace(b"payload", b"pAyload"))


def test_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []

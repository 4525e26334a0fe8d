"""Archives: skipping in compressed files, foreign members, both ways to find revisits, and edge cases."""

import gzip
import hashlib

import pytest

from prismloom.llm import warc


@pytest.fixture
def archive(spark, tmp_path):
    warc.register(spark)

    def write(rows, **options):
        path = str(tmp_path / f"a{len(list(tmp_path.iterdir()))}")
        pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string").repartition(2)
        warc.with_revisits(pages).write.format("warc").options(**options).mode("append").save(path)
        return path

    return write


def test_members_are_plain_gzip_and_can_be_skipped(spark, archive, tmp_path):
    noise = lambda i: "".join(hashlib.sha256(b"%d.%d" % (i, j)).hexdigest() for j in range(3000))
    path = archive([(i, f"u{i}", noise(i), None) for i in range(5)] + [(7, "u7", noise(3), None)], compression="gzip")
    files = [f for f in (tmp_path / path).iterdir() if f.name.endswith(".gz")]
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == 6
    for f in files:  # what isn't wanted isn't read: broken payloads don't matter to who wants a revisit
        data, at = bytearray(f.read_bytes()), 0
        while at < len(data):
            size = warc.member_size(bytes(data[at : at + 24]))
            if b"revisit" not in gzip.decompress(bytes(data[at : at + size])):
                data[at + size - 60 : at + size - 8] = bytes(52)
            at += size
        f.write_bytes(bytes(data))
    read = lambda: spark.read.format("warc").load(path)
    assert [(r["id"], r["refers_to"]) for r in read().where("record_type = 'revisit'").collect()] == [("3", "7")]
    with pytest.raises(Exception, match="(?s)."):
        read().where("record_type = 'response'").collect()


def test_members_of_others(spark, tmp_path):
    """Members without lengths, and one member of several records."""
    warc.register(spark)
    records = [warc.record({"payload": b"p%d" % i * 900, "record_type": "response", "url": "u", "id": str(i)}, "2024-01-01T00:00:00Z") for i in range(4)]
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(records[0]) + gzip.compress(records[1] + records[2]) + warc.member(records[3]))
    got = spark.read.format("warc").load(str(tmp_path)).collect()
    assert sorted((r["id"], bytes(r["payload"])) for r in got) == [(str(i), b"p%d" % i * 900) for i in range(4)]


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_edges(spark, archive, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", broadcast)
    long = "é" * 600
    rows = [(None, "n", long, "c"), (1, "a", long, "c"), (2, "a", long, "c"), (2, "b", long, "c"), (3, None, None, "c"), (4, "", "", None), (5, "s", "x" * 999, None), (6, "s", "x" * 999, None), (9, "big", "y" * 3_000_000, None)]
    got = spark.read.format("warc").load(archive(rows, compression="gzip")).collect()
    assert len(got) == len(rows)
    assert sorted((r["id"] or "", r["record_type"], r["refers_to"]) for r in got) == sorted((str(i or ""), "revisit" if i == 1 else "response", "2" if i == 1 else None) for i, *_ in rows)
    sizes = {r["id"]: (r["payload_bytes"], r["payload_digest"]) for r in got}
    assert sizes["9"] == (3_000_000, hashlib.sha1(b"y" * 3_000_000).hexdigest()) and sizes["1"] == (1200, hashlib.sha1(long.encode()).hexdigest())
    assert spark.read.format("warc").load(archive([(1, "a", "b", "c")])).count() == 1
    empty = warc.with_revisits(spark.createDataFrame([], "page_id bigint, url string, html string"))
    assert empty.count() == 0


def test_the_query_gives_every_page(spark, tmp_path):
    pages = [(i, f"u{i}", ("same " * 300) if i % 3 == 0 else f"{i} " * 400 if i % 3 == 1 else "short", "x") for i in range(30)] + [(40, "e", None, "x")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string, key string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in warc.op8_warc(spark, str(tmp_path)).collect()}
    assert len(got) == 31
    for i, _, html, _ in pages:
        data, revisit = (html or "").encode(), i % 3 == 0 and i < 27
        want = (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 27 if revisit else None)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == want

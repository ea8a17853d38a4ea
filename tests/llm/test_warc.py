import gzip
import hashlib
import io
import os

from visigraph.llm import warc

BIG = "<p>ä" * 600
PAGES = "page_id long, url string, html string, payload string, digest string, shard int"


def pages(spark):
    rows = [(1, "http://a/\r\nX: y", BIG), (2, None, BIG), (3, "http://c", BIG), (4, "http://d", None), (5, "http://e", ""), (6, "u", "small"), (7, "u", "small"), (8, "u", "x" * 3_000_000), (9, "u", "a\r\n\r\nb" * 300), (3, "http://c", BIG), (None, "n", BIG), (10, "u", "WARC/1.1\r\n\r\n")]
    return spark.createDataFrame([(*r, "p", "d", 1) for r in rows], PAGES)


def test_edge_rows_as_sql(spark, same_as_sql):
    same_as_sql(warc.op3_warc, warc.SQL, pages=pages(spark))


def test_files_roll_and_hold_exact_payloads(spark, tmp_path):
    out = f"file://{tmp_path}/w"
    manifest = {r.file: r for r in warc.write_archives(pages(spark), out, roll_bytes=300, shard_bytes=10_000).collect()}
    names = sorted(f for f in os.listdir(tmp_path / "w") if f.endswith(".gz"))
    assert names == sorted(manifest) and len(names) > 3
    for f in names:
        raw = (tmp_path / "w" / f).read_bytes()
        assert hashlib.sha1(raw).hexdigest() == manifest[f].sha1
        assert gzip.decompress(raw).count(b"WARC-Record-ID") == manifest[f].records  # each file is an ordinary gzip file
    rows = warc.read_archives(spark, out).collect()
    assert all(r.valid for r in rows) and len(rows) == 12
    want = {8: "x" * 3_000_000, 9: "a\r\n\r\nb" * 300, 4: "", 10: "WARC/1.1\r\n\r\n"}
    assert {r.page_id: r.payload.decode() for r in rows if r.page_id in want} == want


def test_reruns_write_the_same_bytes(spark, tmp_path):
    sums = []
    for i in range(2):
        m = warc.write_archives(pages(spark).repartition(3 + i), f"file://{tmp_path}/w{i}", roll_bytes=300, shard_bytes=10_000)
        sums.append(sorted((r.file, r.sha1) for r in m.collect()))
    assert sums[0] == sums[1]


def test_files_that_the_manifest_lacks_are_not_read(spark, tmp_path):
    out = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark), out)
    (tmp_path / "w" / "shard-000000-00099.warc.gz").write_bytes(b"left over")
    assert warc.read_archives(spark, out).count() == 12


def test_empty_table_and_cut_archive(spark, tmp_path):
    out = f"file://{tmp_path}/w"
    assert warc.write_archives(pages(spark).limit(0), out).count() == 0 and warc.read_archives(spark, out).count() == 0
    member = warc.write_record(1, "u", b"abc", None)
    assert [warc.read_record(m)["payload"] for m in warc.read_members(io.BytesIO(member * 3))] == [b"abc"] * 3
    try:
        list(warc.read_members(io.BytesIO(member[:-20])))
        raise AssertionError
    except ValueError:
        pass

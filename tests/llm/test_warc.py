import io

import pytest

from cohortspark.llm import warc

SCHEMA = "page_id long, url string, html string"


def through(spark, rows, **options):
    folder = warc.archive_folder(spark)
    archives = warc.write_archives(spark.createDataFrame(rows, SCHEMA), folder, **options)
    return {(r.page_id, r.record_type, r.refers_to): r for r in warc.read_archives(archives, folder).collect()}, archives


def test_round_trip(spark):
    page = "<html>é\r\n\r\nWARC/1.1\r\n" + "x" * 5000
    rows = [(1, "http://a", page), (5, None, page), (3, "http://c d", page), (7, "http://e", None), (8, "http://f\r\nX: y", ""), (9, "u", "own")]
    got, _ = through(spark, rows)
    assert set(got) == {(5, "response", None), (1, "revisit", 5), (3, "revisit", 5), (8, "response", None), (7, "revisit", 8), (9, "response", None)}
    assert bytes(got[5, "response", None].payload).decode() == page
    assert got[1, "revisit", 5].payload is None
    assert got[1, "revisit", 5].payload_bytes == len(page.encode()) == got[5, "response", None].payload_bytes
    assert got[1, "revisit", 5].payload_digest == warc.sha1_base32(page.encode())
    assert got[8, "response", None].url == "http://f%0D%0AX:%20y"


def test_repeats_nulls_and_empty(spark):
    got, _ = through(spark, [(2, "a", "p"), (2, "a", "p"), (None, "b", "p"), (None, "c", "q")])
    assert {k[1:] for k in got if k[0] is None} == {("revisit", 2), ("response", None)}
    assert (2, "response", None) in got
    assert through(spark, [(1, "a", "b")])[1].count() == 1
    folder = warc.archive_folder(spark)
    none = warc.write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert warc.read_archives(none, folder).count() == 0


def test_many_archives_with_dictionaries(spark):
    rows = [(i, f"http://x/{i}", "<div class='post'>" + f"word{i} and {i * i} " * 1500) for i in range(600)]
    got, archives = through(spark, rows, archive_bytes=4000)
    assert len(got) == 600 and archives.count() > 1
    assert sum(r.records for r in archives.collect()) == 600


def archive(records, dictionary=b""):
    out = io.BytesIO()
    w = warc.ArchiveWriter(out, dictionary)
    for r in records:
        w.write(r)
    return out.getvalue()


def read(data):
    return list(warc.read_archive(io.BytesIO(data), "t"))


def test_dictionary_frame():
    records = [warc.record_bytes(i, f"http://host/{i}", (f"<html><head><title>page {i}</title></head><body>" + "text " * 50).encode()) for i in range(200)]
    dictionary = warc.train_dictionary(records)
    assert dictionary
    data = archive(records, dictionary)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert len(read(data)) == 200 and len(data) < len(archive(records))
    with pytest.raises(warc.WarcError):
        read(data[int.from_bytes(data[4:8], "little") + 8 :])  # the records without their dictionary


@pytest.mark.parametrize("break_", [lambda d: d[:-1], lambda d: d[:-5], lambda d: d + b"\0" * 20, lambda d: b"\1" + d[1:], lambda d: d[:30] + bytes([d[30] ^ 255]) + d[31:]])
def test_broken_archives(break_):
    data = archive([warc.record_bytes(1, "u", b"a" * 100), warc.record_bytes(2, "u", b"b" * 100)])
    assert len(read(data)) == 2
    with pytest.raises(warc.WarcError):
        read(break_(data))


@pytest.mark.parametrize("old,new", [(b"Content-Length: ", b"Content-Length: 1"), (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Type: ", b"WARC-Kind: "), (b"WARC-Date", b"WARC-Type"), (b"aaa", b"aab"), (b"WARC-Date: ", b"WARC Date: ")])
def test_wrong_records(old, new):
    with pytest.raises(warc.WarcError):
        read(archive([warc.record_bytes(1, "u", b"aaa").replace(old, new)]))

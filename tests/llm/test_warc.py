"""Archives of other writers, broken archives, and archives that are cut at a number of records or a size."""

import hashlib
import os
import struct

import pytest
import zstandard

from skillspark.llm import warc


def row(i, payload=b"<p>hello</p>" * 20, **more):
    return warc.record(i, f"http://x.org/{i}", payload, hashlib.sha256(payload).hexdigest(), "response", None)


def dictionary():
    return zstandard.ZstdCompressionDict(b"WARC/1.1 Content-Length: http://x.org/ <p>hello</p>" * 40, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def skippable(data, magic=warc.DICTIONARY_MAGIC):
    return struct.pack("<II", magic, len(data)) + data


def streamed(data, words=None):
    """A frame without the size of its content."""
    c = zstandard.ZstdCompressor(dict_data=words, write_content_size=False).compressobj() if words else zstandard.ZstdCompressor(write_content_size=False).compressobj()
    return c.compress(data) + c.flush()


def test_foreign_archives(spark, tmp_path):
    words = dictionary()
    plain = skippable(words.as_bytes()) + b"".join(zstandard.ZstdCompressor(dict_data=words).compress(row(i)) for i in range(3))
    packed = skippable(zstandard.ZstdCompressor().compress(words.as_bytes())) + b"".join(streamed(row(i), words) for i in range(3, 6))
    bare = b"".join(streamed(row(i)) + skippable(b"note", 0x184D2A55) for i in range(6, 8))
    for name, data in (("a.warc.zst", plain), ("b.warc.zst", packed), ("c", bare), ("d.warc.zst", b"")):
        (tmp_path / name).write_bytes(data)
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in rows) == list(range(8)) and {bytes(r.payload) for r in rows} == {b"<p>hello</p>" * 20}


@pytest.mark.parametrize("old,new,said", [
    (b"Content-Length: ", b"Content-Length: x", "no number"), (b"http://x.org/1", b"http://x.\xff\xfe/1", "UTF-8"), (b"WARC/1.1", b"WARC/9.9", "no WARC header"),
    (b"WARC-Date", b"WARC-Bate", "no warc-date"), (b"<p>hello", b"<p>hallo", "digest"), (b"</p>\r\n\r\n", b"</p>\r\n", "bytes, not"),
])
def test_broken_records_say_where(old, new, said):
    good, bad = row(0), row(1)
    place = bad.rindex(old) if old == b"</p>\r\n\r\n" else bad.index(old)
    bad = bad[:place] + new + bad[place + len(old) :]
    frames = zstandard.ZstdCompressor()
    with pytest.raises(warc.Broken, match=f"frame 2: .*{said}"):
        list(warc.records(frames.compress(good) + frames.compress(bad)))


def test_a_broken_file_is_named(spark, tmp_path):
    (tmp_path / "cut.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(row(1))[:-3])
    with pytest.raises(Exception, match="cut.warc.zst"):
        warc.read(spark, str(tmp_path)).collect()


def test_archives_are_cut(spark, tmp_path):
    texts = [(i, f"http://x/{i}", (f"<html>{i} " + "abc " * (i % 50)) if i % 5 else "") for i in range(120)] + [(None, None, None), (7, "again", "x" * 500), (8, "again", "x" * 500), (9, "long", "y" * 3_000_000)]
    pages = spark.createDataFrame(texts, "page_id long, url string, html string").repartition(2)
    for records, size in ((16, 1 << 30), (1 << 20, 2000)):
        kept = warc.RECORDS, warc.ARCHIVE_BYTES
        path = str(tmp_path / f"cut{records}")
        try:
            warc.RECORDS, warc.ARCHIVE_BYTES = min(records, 64), size
            rows = [r for r in _archives(pages, path)]
        finally:
            warc.RECORDS, warc.ARCHIVE_BYTES = kept
        files = [f for f in os.listdir(path) if f.startswith("part-")]
        assert len(files) > 2
        for f in files:
            data = open(f"{path}/{f}", "rb").read()
            assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC and list(warc.records(data))
        assert sorted((r.page_id or -1, r.record_type) for r in rows) == sorted((i or -1, "revisit" if (i, u) == (8, "again") else "response") for i, u, _ in texts)


def _archives(pages, path):
    """Writes in one task each, in this process, so that the sizes that are set here hold."""
    spark, size, records = pages.sparkSession, warc.ARCHIVE_BYTES, warc.RECORDS
    own = warc._archive

    def archive(batches):
        warc.RECORDS, warc.ARCHIVE_BYTES = records, size
        return own(batches)

    warc._archive = archive
    try:
        warc.write(pages, path)
    finally:
        warc._archive = own
    return warc.read(spark, path).collect()

"""Archives against the zipfile and gzip modules, the query against its SQL and on the defined cases."""

import gzip
import hashlib
import io
import zipfile

import duckdb
import pytest

from folioforge.llm.queries_warc import OP4_SQL, op4_warc_zip
from folioforge.llm.warc_zip import RECORDS, central_directory, read_archives, stored_at, write_archives


@pytest.mark.parametrize("limit", [None, 10])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 a comment that looks like an end record"])
def test_directories(monkeypatch, limit, comment):
    if limit:  # everything is written as ZIP64
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.comment = comment
        for i in range(5):
            z.writestr(f"d/m{i}", b"x" * 100 * i, zipfile.ZIP_DEFLATED if i == 3 else zipfile.ZIP_STORED)
    data = buffer.getvalue()
    read = lambda at, n: data[at : at + n]
    members = central_directory(read, len(data))
    assert [m.name for m in members] == [f"d/m{i}" for i in range(5)]
    for i in (0, 1, 2, 4):
        assert read(stored_at(read, members[i]), members[i].size) == b"x" * 100 * i
    with pytest.raises(ValueError):
        stored_at(read, members[3])
    with pytest.raises(ValueError):
        central_directory(lambda at, n: b"not a zip"[at : at + n], 9)


def test_defined_cases(spark, tmp_path):
    big = "é" * 300_000
    html = [None, "", "short", "short", "x" * 100, "x" * 100, "x" * 99, "x" * 99, big, big, "y" * 200, "y" * 200]
    rows = [(None if i == 11 else i, None if i == 2 else f"http://h/{i}\r\nä", h, 1) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    archives = write_archives(pages, str(tmp_path / "out"))
    for path in [r.path for r in archives.collect()]:
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None
            assert gzip.decompress(z.read(RECORDS)).startswith(b"WARC/1.1\r\n")
    got = {r.page_id: r for r in read_archives(archives).collect()}
    assert len(got) == len(rows)
    for i, h in enumerate(html):
        r = got[rows[i][0]]
        data = (h or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        first = {5: 4, 9: 8, 11: 10}.get(i)
        assert (r.record_type, r.refers_to) == (("revisit", first) if first else ("response", None))
        assert r.payload == (None if first else data)
    assert read_archives(write_archives(pages.limit(0))).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, op4_warc_zip(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert got == sorted(con.execute(OP4_SQL).fetchall())

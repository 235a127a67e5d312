import gzip
import hashlib
import io
import random
import uuid

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, Not

from cohortscope.llm import common, warc
from helpers import LONG, no_docs, odd_docs, shipped  # noqa: F401

PAGES = "page_id long, url string, html string, fields string, digest long, copies string, payload double"


@pytest.fixture
def folder(spark):
    warc.register(spark)
    return f"{common.shared_dir(spark)}/tables/warc-test-{uuid.uuid4().hex}"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 0.5) for r in rows], PAGES)


def expected(rows):
    payloads = {}
    for page, _, html in rows:
        if page is not None:
            payloads.setdefault(html or "", []).append(page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = min(payloads.get(html or "", [page]), default=None) if len(raw) >= 100 else page
        again = first is not None and first != page
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a.example/ä b?x=1\r\nWARC-Type: evil", "é" * 60), (3, None, "é" * 60), (None, "http://b.example/", "é" * 60),
    (3, "http://c.example/", "é" * 60), (7, "http://d.example/", "short"), (8, "http://d.example/", "short"),
    (9, "u", None), (10, "u", ""), (11, "http://e.example/", LONG), (12, "http://f.example/", LONG),
    (13, "http://g.example/", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (None, None, None),
    (None, "h", "z" * 200), (None, "i", "z" * 200), (14, "j", "x" * 99), (15, "j", "x" * 99), (16, "j", "x" * 100), (17, "j", "x" * 100),
]


def test_odd_pages_round_trip(spark, folder):
    """Null ids, urls and html, repeated ids, header injection, very long texts, clashing columns."""
    warc.write_pages(pages(spark, ROWS).repartition(3), folder)
    assert sorted(map(tuple, warc.read_pages(spark, folder).collect()), key=str) == expected(ROWS)


def test_hot_payload_over_many_files(spark, folder, monkeypatch):
    """A third of all pages share one payload; files of a few records each."""
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    rnd = random.Random(3)
    rows = [(k, f"http://x.example/{k}", "hot " * 50 if k % 3 == 0 else f"page {rnd.randrange(60)} " * 20) for k in range(300)]
    warc.write_pages(pages(spark, rows).repartition(4), folder, fileBytes="2000")
    assert len(warc.listed(folder)) > 20
    assert sorted(map(tuple, warc.read_pages(spark, folder).collect()), key=str) == expected(rows)


def test_empty_table(spark, folder):
    warc.write_pages(pages(spark, []), folder)
    assert warc.read_pages(spark, folder).collect() == []


def test_records_as_written(spark, folder):
    warc.write_pages(pages(spark, ROWS), folder)
    df = spark.read.format("warc").load(folder)
    assert {r.record_type for r in df.collect()} == {"warcinfo", "response", "revisit"}
    by_page = {r.fields.get("x-page-id"): r for r in df.filter("record_type <> 'warcinfo'").collect()}
    again, first = by_page["12"], by_page["11"]
    assert again.refers_to == first.record_id and again.refers_to_uri == first.target_uri == "http://e.example/"
    assert again.payload is None and again.http_length == len(LONG) and bytes(first.payload) == LONG.encode()
    assert by_page["5"].target_uri == "http://a.example/%C3%A4%20b?x=1%0D%0AWARC-Type:%20evil"
    assert by_page["5"].fields["warc-profile"] == warc.SAME_PAYLOAD and "warc-profile" not in first.fields


def test_predicates_reach_the_reader(spark, folder):
    warc.write_pages(pages(spark, ROWS), folder)
    df = spark.read.format("warc").load(folder)
    asked = df.filter("record_type = 'revisit' AND content_length > 0 AND payload_digest LIKE 'sha256:%' AND http_length >= 100")
    plan = asked._jdf.queryExecution().toString()
    left = [line for line in plan.split("== Physical Plan ==")[1].split("\n") if "Filter (" in line]
    assert left and all("http_length" in line and "record_type" not in line for line in left), plan
    assert asked.count() == sum(r[3] == "revisit" for r in expected(ROWS))


def file_of(records, sl=True):
    out = b""
    for head, block in records:
        data = warc.record(head, block)
        out += warc.member(data, 6) if sl else gzip.compress(data)
    return out


def some_records():
    rnd = random.Random(8)
    noise = bytes(rnd.randrange(256) for _ in range(300_000))
    return [([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a>")], noise), ([("WARC-Type", "metadata")], b""),
            ([("WARC-Type", "response"), ("X-Long", "v" * 20_000)], b"\r\n\r\nWARC/1.1\r\n\r\n"),
            ([("WARC-Type", "request")], noise * 12), ([("WARC-Type", "response")], b"end")]


@pytest.mark.parametrize("form", ["sl", "members", "plain"])
def test_other_writers_files(form):
    """Gzip members with and without lengths, and plain files, read alike, with any records wanted."""
    records = some_records()
    data = b"".join(warc.record(*r) for r in records) if form == "plain" else file_of(records, form == "sl")
    for kinds in ({"response"}, {"request", "metadata"}, {"response", "request", "metadata"}, set()):
        got = list(warc.read_records(io.BytesIO(data), lambda row: row["record_type"] in kinds, True))  # noqa: B023
        assert [b for _, _, b in got] == [b for h, b in records if h[0][1] in kinds]


def test_unwanted_records_are_stepped_over():
    """With lengths in the members, unwanted blocks are neither inflated nor, beyond a chunk, read."""
    rnd = random.Random(1)
    big = rnd.randbytes(6 << 20)
    data = file_of([([("WARC-Type", "request")], big)] * 5 + [([("WARC-Type", "response")], b"x")])

    class Counted(io.BytesIO):
        got = 0

        def read(self, n=-1):
            made = super().read(n)
            self.got += len(made)
            return made

    file = Counted(data)
    assert len(list(warc.read_records(file, lambda row: row["record_type"] == "response", True))) == 1
    assert file.got < 8 * warc.CHUNK < len(data) / 3


def test_broken_files_are_errors():
    whole = file_of(some_records())
    for data in (whole[:-20], b"not a record at all", gzip.compress(b"".join(warc.record(*r) for r in some_records()[:2]))):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(data), lambda row: False if data[:2] != b"no" else True, True))  # noqa: B023


def test_predicates():
    row = {"record_type": "response", "target_uri": None}
    test = lambda f: warc.as_test(f)[1](row[warc.as_test(f)[0]])
    assert test(EqualTo(("record_type",), "response")) and not test(Not(EqualTo(("target_uri",), "a")))
    assert test(In(("record_type",), ("revisit", "response"))) and warc.as_test(EqualTo(("payload",), b"")) is None


def test_files_of_failed_writes_are_not_read(spark, folder):
    warc.write_pages(pages(spark, ROWS[:3]), folder)
    store, at = warc.filesystem(folder)
    with store.open_output_stream(f"{at}/part-lost.warc.gz", compression=None) as f:
        f.write(file_of(some_records()))
    assert warc.read_pages(spark, folder).count() == 3
    warc.write_pages(pages(spark, ROWS[4:6]), folder)
    assert warc.read_pages(spark, folder).count() == 5
    warc.page_records(pages(spark, ROWS[6:7])).write.format("warc").mode("overwrite").save(folder)
    assert warc.read_pages(spark, folder).count() == 1
    assert isinstance(store, pafs.LocalFileSystem)


def test_partitions_by_size(spark, folder):
    warc.write_pages(pages(spark, [(k, "u", f"{k} " * 100) for k in range(200)]), folder, fileBytes="1500")
    df = spark.read.format("warc").option("splitBytes", "4000").load(folder)
    assert df.rdd.getNumPartitions() > 3 and df.filter(F.col("record_type") == "response").count() == 200


def test_documents_are_no_pages(spark, folder):
    """Any table with three such columns will do."""
    docs = odd_docs(spark)
    warc.page_records(docs, id_col="doc_id", url_col="source", html_col="text").write.format("warc").mode("append").save(folder)
    assert warc.read_pages(spark, folder).count() == docs.count()
    assert warc.page_records(no_docs(spark), id_col="doc_id", url_col="source", html_col="text").count() == 0

"""Archives: what was written is what is read, and unwanted blocks are skipped."""

import base64
import hashlib
import io
import re

import pytest
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from sparktidy.llm import warc
from sparktidy.session import work_folder

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                      T.StructField("html", T.StringType())])


@pytest.fixture
def pages_of(spark):
    return lambda rows, parts=3: spark.createDataFrame(rows, PAGES).repartition(parts)


ROWS = [(5, "http://a/1", "<p>one</p>"), (3, "http://a/2", "<p>one</p>"), (9, None, "<p>one</p>"), (4, "http://b", None),
        (7, "http://b c\r\nX: y", ""), (8, "u", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (10, "é", "ünï 😀\r\n\r\n"),
        (11, "x", "y" * 300_000), (12, "x", "line\nline\r\n"), (None, "n", "<p>one</p>"), (None, "n", "only null")]


def wanted(rows, least=0):
    out, first = [], {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None:
            first[body] = min(first.get(body, i), i)
    for i, _, html in rows:
        body = (html or "").encode()
        one = first.get(body)
        again = len(body) >= least and one is not None and i != one
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response",
                    one if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(pages_of, clashing):
    assert rows_of(warc.round_trip(clashing(pages_of(ROWS)))) == wanted(ROWS)


def test_small_payloads_are_whole(pages_of):
    assert rows_of(warc.round_trip(pages_of(ROWS), least_bytes=5)) == wanted(ROWS, 5)


def test_repeated_rows(pages_of):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same")]
    assert [r[3] for r in rows_of(warc.round_trip(pages_of(rows)))] == ["response", "response", "revisit"]


def test_empty(pages_of):
    assert warc.round_trip(pages_of([])).count() == 0


def test_payloads_and_headers(spark, pages_of):
    path = work_folder(spark, "archive")
    warc.write_archive(warc.plan_records(pages_of(ROWS)), path, records_per_file=2)
    found = warc.read_archive(spark, path)
    bodies = {r.record_id: bytes(r.payload).decode() for r in found.where("record_type = 'response'").collect()}
    assert bodies["<urn:x-page:8>"] == ROWS[5][2] and bodies["<urn:x-page:10>"] == ROWS[6][2]
    assert bodies["<urn:x-page:12>"] == ROWS[8][2] and len(bodies["<urn:x-page:11>"]) == 300_000
    assert [r.target_uri for r in found.where("record_id = '<urn:x-page:7>'").collect()] == ["http://b%20c%0D%0AX:%20y"]
    assert found.where("target_uri IS NULL").count() == 1
    bare = warc.read_archive(spark, path, payload=False)
    assert bare.count() == len(ROWS) and bare.where("payload IS NOT NULL").count() == 0
    plan = found.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)  # nothing is left to test after the scan


RECORD = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x-page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"


class Watched(io.BytesIO):
    """Remembers how much was asked for at once."""

    def __init__(self, data):
        super().__init__(data)
        self.asked = []

    def read(self, n=-1):
        self.asked.append(n)
        return super().read(n)


def test_unwanted_blocks_are_skipped():
    big = b"z" * (3 << 20)
    stream = Watched(RECORD % (b"resource", 1, len(big), big) + RECORD % (b"metadata", 2, 4, b"abcd"))
    found = list(warc.parse(stream, lambda h: h["warc-type"] == "metadata", True))
    assert [(h["warc-record-id"], n, b) for h, n, b in found] == [("<urn:x-page:2>", 4, b"abcd")]
    assert max(stream.asked) <= 1 << 20


def test_broken_archives():
    for data in (b"junk\r\n", (RECORD % (b"resource", 1, 10, b"short"))[:-4]):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(data), lambda h: True, True))


def test_filters_that_headers_decide():
    reader = warc.WarcReader({"path": "/nowhere"})
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("payload_digest",), ("a", "b")),
                                    StringStartsWith(("target_uri",), "http://a"), GreaterThan(("payload_bytes",), 5)]))
    assert [type(f) for f in left] == [GreaterThan]
    good = {"warc-type": "response", "warc-payload-digest": "b", "warc-target-uri": "http://a/x"}
    assert reader.wanted(good) and not reader.wanted(good | {"warc-type": "revisit"}) and not reader.wanted({})


def test_base32(spark):
    from pyspark.sql import functions as F
    texts = ["", "a", "xyz" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.sha1_base32(F.col("t")).alias("d"))
    assert {r.t: r.d for r in df.collect()} == {t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts}

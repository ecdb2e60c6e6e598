import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from rillmark.llm import warc

ROWS = [(3, "http://a", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (5, "http://c\r\nX: y", ""), (4, "http://d", "x" * 5000), (7, "http://a", "<p>é</p>"), (7, "http://a", "<p>é</p>"), (None, "http://n", "alone"), (None, "http://m", "<p>é</p>")]


def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("length", F.lit(1)).withColumn("_first", F.lit("x"))


def test_round_trip(spark, tmp_path):
    out = warc.archive_pages(pages(spark), path=str(tmp_path / "a")).collect()
    first = {}
    for i, _, html in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    want = []
    for i, _, html in ROWS:
        b = (html or "").encode()
        own = first[html or ""] == i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else first[html or ""]))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in out)
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == len({(h or "") for _, _, h in ROWS})


def test_record_bytes_and_small_payloads(spark, tmp_path):
    path = warc.write_archive(pages(spark), str(tmp_path / "b"), min_revisit_bytes=8)
    records = warc.read_records(spark, path)
    assert records.where(warc.header_field("WARC-Type") == "revisit").count() == 4
    one = bytes(warc.record_bytes(records.where("record_key = 1")).first()["record"])
    head, body = one.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\n") and b"Content-Length: 9" in head and body == "<p>é</p>".encode() + b"\r\n\r\n"
    two = bytes(warc.record_bytes(records.where("record_key = 3")).first()["record"])
    assert two.endswith(b"\r\n\r\n\r\n\r\n") and b"WARC-Refers-To: <urn:rillmark:page:1>" in two


def test_damage_is_noticed_and_empty_table(spark, tmp_path):
    path = warc.write_archive(pages(spark), str(tmp_path / "c"))
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"bad")).write.parquet(str(tmp_path / "d/payloads"))
    spark.read.parquet(f"{path}/records").write.parquet(str(tmp_path / "d/records"))
    with pytest.raises(Exception, match="digest"):
        warc.read_records(spark, str(tmp_path / "d")).collect()
    assert warc.archive_pages(pages(spark).where("page_id > 99"), path=str(tmp_path / "e")).count() == 0


def test_a_payload_of_many_records_is_read_once(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "z" * 3000) for i in range(200)] + [(None, None, "z" * 3000)] * 3 + [(500, "u", "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    out = warc.archive_pages(df, path=str(tmp_path / "hot"))
    got = out.collect()
    assert len(got) == 204 and {r.refers_to for r in got if r.record_type == "revisit"} == {0} and sum(r.record_type == "revisit" for r in got) == 202
    # only digests meet records: the plan reads payload bytes below the join alone
    assert spark.read.parquet(str(tmp_path / "hot/payloads")).count() == 2
    assert warc.read_records(spark, str(tmp_path / "hot")).where("payload is not null").count() == 204

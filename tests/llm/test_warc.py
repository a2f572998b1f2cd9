"""WARC records: reading, resolving, and rows that are repeated, damaged or hot."""

import gzip

from pyspark.sql import functions as F
from tesela.llm import warc

SCHEMA = "record_id string, type string, url string, at long, profile string, status int, headers map<string,string>, body string, n long, salt long, body_of string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).withColumn("ts", F.timestamp_seconds("at"))


def resolved(records, **options):
    return warc.with_bodies(warc.resolve_revisits(records, **options), records)


def test_warc_round_trip(spark, tmp_path):
    record = warc.write_record
    parts = [
        record("response", "http://www.A.org:80/p/?b=2&a=1&utm_x=3#top", "2024-01-01T00:00:00Z", 200, {"ETag": '"1"', "X": "old", "Content-Type": "text/html"}, b"one", "r1"),
        record("revisit", "https://a.org/p?a=1&b=2", "2024-01-05T00:00:00Z", 304, {"etag": 'W/"1"', "X": "new", "Content-Type": "text/plain"}, record_id="v1"),
        record("response", "http://a.org/p?a=1&b=2", "2024-01-06T00:00:00Z", 200, {"ETag": '"2"'}, b"two", "r2"),
        record("revisit", "http://a.org/p?a=1&b=2", "2024-01-06T00:00:01Z", 304, {"ETag": '"1"'}, record_id="v2"),
        record("revisit", "http://a.org/p?a=1&b=2", "2023-01-01T00:00:00Z", 304, {}, record_id="v3"),
        record("revisit", "http://a.org/p?a=1&b=2", "2024-01-06T00:00:00Z", 304, {"Etag": '"1"'}, record_id="v4"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts) + parts[0][:40])
    records = warc.read_warc(spark, str(tmp_path / "a.warc.gz"))
    out = {r.record_id: r for r in warc.with_bodies(warc.resolve_revisits(records), records).collect()}
    told = {k: (r.outcome, r.refers_to, r.body and bytes(r.body)) for k, r in out.items()}
    assert told == {
        "v1": ("resolved", "r1", b"one"), "v2": ("etag-mismatch", "r2", None), "v3": ("no-response", None, None),
        "v4": ("resolved", "r1", b"one"),
    }
    assert out["v1"].headers == {"etag": 'W/"1"', "x": "new", "content-type": "text/html"}


def test_warc_full_responses_and_profiles(spark):
    digest = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    stored = [("page", 200), ("part", 206), ("same", 304), ("gone", 404), ("busy", 503), ("none", None)]
    rows = [(name, "response", "http://a.org/", 10 * k, None, status, {}, name) for k, (name, status) in enumerate(stored)]
    rows += [
        ("v1", "revisit", "http://a.org/", 99, None, 304, {}, None),
        ("v2", "revisit", "http://a.org/", 99, warc.PROFILE, 304, {}, None),
        ("v3", "revisit", "http://a.org/", 99, warc.PROFILE.replace("1.1", "1.0"), None, {}, None),
        ("v4", "revisit", "http://a.org/", 99, digest, 200, {"X": "own"}, None),
        ("v5", "revisit", "http://a.org/", 99, None, 200, {}, None),
        ("v6", "revisit", "http://a.org/", 99, digest, 304, {}, None),
        ("late", "revisit", "http://a.org/", 200_099, " ", 304, {}, None),
        ("lone", "response", "http://b.org/", 1, None, 404, {}, "lone"),
        ("v7", "revisit", "http://b.org/", 2, None, 304, {}, None),
    ]
    schema = "record_id string, type string, url string, at long, profile string, status int, headers map<string,string>, body string"
    records = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at"))
    out = {r.record_id: r for r in warc.with_bodies(warc.resolve_revisits(records, need_validator=False), records).collect()}
    page, other = ("resolved", "page", 200, "page"), ("other-profile", None, None, None)
    assert {k: (r.outcome, r.refers_to, r.status, r.body) for k, r in out.items()} == {
        "v1": page, "v2": page, "v3": page, "v4": other, "v5": other, "v6": other, "late": page,
        "v7": ("no-response", None, None, None),
    }
    assert out["v4"].headers == {"x": "own"}


def test_repeated_rows_ties_and_null_ids(spark):
    tag = {"ETag": '"1"'}
    rows = [("r1", "response", "http://a.org/", 1, None, 200, tag, "one")] * 3
    rows += [("r1", "response", "http://a.org/", 1, None, 200, tag, "a later body by its bytes: two")]
    rows += [(None, "response", "http://a.org/", 5, None, 200, tag, "null id")]
    rows += [("v1", "revisit", "http://a.org/", 9, None, 304, tag, None)] * 2
    rows += [(None, "revisit", "http://a.org/", 9, None, 304, tag, None), ("v2", "revisit", None, 9, None, 304, tag, None)]
    rows += [("v3", "revisit", "http://a.org/", None, None, 304, tag, None), ("v4", "revisit", "http://a.org/", 9, None, 304, None, None)]
    out = sorted((str(r.record_id), r.outcome, r.refers_to, r.body) for r in resolved(frame(spark, rows)).collect())
    assert out == [
        ("None", "resolved", "r1", "one"), ("v1", "resolved", "r1", "one"), ("v1", "resolved", "r1", "one"),
        ("v2", "no-response", None, None), ("v3", "no-response", None, None), ("v4", "no-validator", "r1", None),
    ]


def test_validators(spark):
    stored = {"ETag": 'W/"1"', "Last-Modified": "Mon"}
    rows = [("r", "response", "http://a.org/", 1, None, 200, stored, "b")]
    for name, headers in {
        "weak": {"etag": '"1"'}, "other": {"ETAG": '"2"'}, "date": {"last-modified": "Mon "}, "old": {"Last-Modified": "Sun"},
        "both": {"ETag": 'W/"1"', "Last-Modified": "Sun"}, "none": {"Date": "Mon"},
    }.items():
        rows.append((name, "revisit", "http://a.org/", 2, warc.PROFILE, 304, headers, None))
    out = {r.record_id: r.outcome for r in resolved(frame(spark, rows)).collect()}
    assert out == {
        "weak": "resolved", "other": "etag-mismatch", "date": "resolved", "old": "date-mismatch", "both": "resolved",
        "none": "no-validator",
    }


def test_a_hot_response(spark):
    tag = {"ETag": '"1"'}
    rows = [(f"r{k}", "response", f"http://a.org/{k}", 1, None, 200, tag, f"body {k}") for k in range(30)]
    rows += [(f"v{k}", "revisit", f"http://a.org/{k % 30 if k % 2 else 7}", 2 + k, None, 304, tag, None) for k in range(2500)]
    out = resolved(frame(spark, rows)).collect()
    assert len(out) == 2500
    assert all(r.body == f"body {int(r.record_id[1:]) % 30 if int(r.record_id[1:]) % 2 else 7}" for r in out)


def test_empty_table(spark):
    assert resolved(frame(spark, [])).collect() == []


def test_pieces_of_any_kind(spark, tmp_path):
    """Blocks that hold separators, lengths that aren't numbers, no block, other versions, and a cut at the end."""
    record = warc.write_record
    nested = b"<p>" + warc.PLAIN_SEPARATOR + b"1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc" + warc.PLAIN_SEPARATOR + b"0\r\n"
    raw = [
        record("response", "http://a.org/1", "2024-01-01T00:00:00Z", 200, {"A": "b"}, nested, "r1"),
        gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nx\r\n\r\n"),
        gzip.compress(b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
        gzip.compress(b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: -5\r\n\r\nab\r\n\r\n"),
        record("response", "http://a.org/2", "not a date", 200, {}, b"", "r2"),
        record("response", "http://a.org/3", "2024-01-01T00:00:00Z", 200, {}, bytes(range(256)) * 3, "r3"),
    ]
    want = [("r1", nested), (None, b""), ("r2", b""), ("r3", bytes(range(256)) * 3)]
    cut = record("response", "http://a.org/4", "2024-01-01T00:00:00Z", 200, {}, b"z" * 5000, "r4")
    plain = gzip.decompress(b"".join(raw))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(raw) + cut[: len(cut) // 2])
    (tmp_path / "b.warc").write_bytes(plain + gzip.decompress(cut)[:300])
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    for name in ("a.warc.gz", "b.warc"):
        mine = sorted((r for r in rows if r.file.endswith(name)), key=lambda r: r.offset)
        assert [(r.record_id, bytes(r.body)) for r in mine] == want, name
    assert [(r["record_id"], r["body"]) for r in warc.parse_warc(b"".join(raw))] == want


def test_a_file_larger_than_a_split(spark, tmp_path):
    one = gzip.decompress(warc.write_record("response", "http://a.org/", "2024-01-01T00:00:00Z", 200, {}, b"y" * 700_000, "r"))
    (tmp_path / "big.warc").write_bytes(one * 40)
    (tmp_path / "big.warc.gz").write_bytes(gzip.compress(one) * 40)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3m")
    try:
        found = warc.read_warc(spark, str(tmp_path)).groupBy("file").agg(F.count("*").alias("n"), F.max(F.length("body")).alias("s"))
        assert [(r.n, r.s) for r in found.collect()] == [(40, 700_000)] * 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

"""WARC records, and the resolution of not-modified revisits.

A server-not-modified revisit holds no body: the archive had met the page before and the server answered 304. It is
resolved by an as-of join: of the full responses of the same canonical URL, the latest one before the revisit
supplies the body. Validators are checked where both records have them: ETags that are equal by weak comparison, or
without ETags on both sides equal Last-Modified dates. A revisit without any comparable validator isn't resolved, unless
need_validator is off. The revisit's headers then replace those of the response, except for the ones that describe the
body or the connection. Full responses are those with a record_id and a status in FULL_STATUS: a 206 holds a part, a 304
no body, and an error isn't the page. A revisit is a not-modified one by its WARC-Profile or, without one, by its
status 304; those of other profiles (identical payload digest) refer to a digest, not to an earlier time, and are never
resolved here.

The join goes by (canonical URL, time slot): inside a slot a window carries the latest response forward; each slot's
last response is a row of a small table, whose windows carry it to later slots of the same URL. So a URL that holds a
third of all records is spread over its time slots. Bodies take no part in it; they are joined to the revisits that
were resolved, and the body that many revisits refer to is sent to several tasks.

Defined results: a record without a URL or a time is never resolved ('no-response'). Of responses at one time the one
with the greatest record_id counts as the later; a response at the revisit's own time is not earlier. Null headers
count as none. Repeated revisit rows are each resolved, once; of response rows with one record_id the latest supplies
the body, of those at one time the one with the greatest status and body. An empty table gives no rows.
"""

from __future__ import annotations

import gzip
import io
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.llm.common import HOT_KEYS, map_arrow, materialize, work_path

#: Header fields of a revisit that never replace those of the stored response (lower case).
NOT_MERGED = (
    "connection",
    "content-encoding",
    "content-length",
    "content-md5",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: WARC 1.0 and 1.1 name the profile under folders of their own.
NOT_MODIFIED_PROFILE = "/revisit/server-not-modified/?$"
NOT_MODIFIED_STATUS = 304
#: Statuses of stored responses that can supply a revisit's body.
FULL_STATUS = (200,)
SLOT_SECONDS = 86_400
#: Bytes of bodies that leave a worker at a time, besides those of one record.
BATCH_BYTES = 8 << 20


def canonical_url(url: Column) -> Column:
    """host/path?query in one form: no scheme, user, default port, 'www.', fragment, trailing slash or utm_ fields;
    lower-case host, query fields sorted."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(plain, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(plain, "^[^/?]*([^?]*)", 1), "/+$", "")
    fields = F.split(F.regexp_extract(plain, "[?](.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(fields, lambda q: (q != "") & ~q.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _lower_keys(headers: Column) -> Column:
    """Header fields by lower-case name; of repeated names the last stays."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.aggregate(
        entries,
        F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(
            F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))
        ),
    )


def is_full() -> Column:
    """Whether a record is a full response that revisits can refer to."""
    found = (F.col("type") == "response") & F.col("status").isin(*FULL_STATUS) & F.col("record_id").isNotNull()
    return F.coalesce(found, F.lit(False))


def resolve_revisits(records: DataFrame, slot_seconds: int = SLOT_SECONDS, need_validator: bool = True) -> DataFrame:
    """One row for each revisit: record_id, url, ts, canonical_url, outcome, refers_to, headers.

    records: record_id, type ('response' or 'revisit'), url, ts, status, headers, and profile unless no record has one.
    outcome is 'resolved', 'etag-mismatch', 'date-mismatch', 'no-validator', 'no-response' or 'other-profile'. refers_to
    is the response's record_id wherever there is one; headers are merged where the revisit is resolved, and its own
    elsewhere. Other columns are not looked at.
    """
    full = is_full()
    profile = F.nullif(F.trim("profile"), F.lit("")) if "profile" in records.columns else F.lit(None).cast("string")
    not_modified = F.coalesce(profile.rlike(NOT_MODIFIED_PROFILE), F.col("status") == NOT_MODIFIED_STATUS, F.lit(False))
    rows = records.where(full | (F.col("type") == "revisit")).select(
        "record_id",
        "url",
        "ts",
        full.alias("full"),
        not_modified.alias("not_modified"),
        canonical_url(F.col("url")).alias("canonical_url"),
        _lower_keys(F.col("headers")).alias("headers"),
    )
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    rows = rows.withColumn("slot", F.floor(F.unix_micros("ts") / (slot_seconds * 1_000_000)))
    response = F.when(F.col("full") & usable, F.struct("ts", "record_id", "headers"))
    url_slot = Window.partitionBy("canonical_url", "slot").orderBy(F.unix_micros("ts"))
    earlier_times = url_slot.rangeBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("near", F.max(_by_time(response)).over(earlier_times))
    slots = rows.where(F.col("full") & usable).groupBy("canonical_url", "slot").agg(F.max(_by_time(response)).alias("last"))
    known = F.when(~F.col("asked"), F.col("last"))
    asked = rows.where(~F.col("full") & usable).select("canonical_url", "slot").distinct()
    before = (
        slots.withColumn("asked", F.lit(False))
        .unionByName(asked.withColumn("asked", F.lit(True)), allowMissingColumns=True)
        .withColumn(
            "far",
            F.last(known, ignorenulls=True).over(
                Window.partitionBy("canonical_url").orderBy("slot").rangeBetween(Window.unboundedPreceding, -1)
            ),
        )
        .where("asked")
        .select("canonical_url", "slot", "far")
    )
    found = here.where(~F.col("full")).join(before, ["canonical_url", "slot"], "left")
    hit = F.when(F.col("not_modified"), F.coalesce("near", "far"))
    found = found.select("record_id", "url", "ts", "canonical_url", "headers", "not_modified", hit.alias("hit"))
    mine, theirs = F.col("headers"), F.map_from_entries("hit.entries")
    etag, held_etag = F.try_element_at(mine, F.lit("etag")), F.try_element_at(theirs, F.lit("etag"))
    date, held_date = (F.try_element_at(m, F.lit("last-modified")) for m in (mine, theirs))
    by_etag = etag.isNotNull() & held_etag.isNotNull()
    outcome = (
        F.when(~F.col("not_modified"), "other-profile")
        .when(F.col("hit").isNull(), "no-response")
        .when(by_etag & (_opaque(etag) != _opaque(held_etag)), "etag-mismatch")
        .when(~by_etag & (F.trim(date) != F.trim(held_date)), "date-mismatch")
        .when(F.lit(need_validator) & ~by_etag & (date.isNull() | held_date.isNull()), "no-validator")
        .otherwise("resolved")
    )
    return found.select(
        "record_id",
        "url",
        "ts",
        "canonical_url",
        outcome.alias("outcome"),
        F.col("hit.record_id").alias("refers_to"),
        F.when(outcome == "resolved", merged_headers(theirs, mine)).otherwise(mine).alias("headers"),
    )


def _by_time(response: Column) -> Column:
    """The struct with its map held as entries, since maps have no order."""
    return F.when(
        response.isNotNull(),
        F.struct(
            response["ts"].alias("ts"),
            response["record_id"].alias("record_id"),
            F.map_entries(response["headers"]).alias("entries"),
        ),
    )


def _opaque(etag: Column) -> Column:
    """What weak comparison looks at, which is that of conditional requests."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """stored with the permitted fields of update in their place."""
    permitted = F.map_filter(update, lambda k, _: ~k.isin(*NOT_MERGED))
    kept = F.map_filter(stored, lambda k, _: ~F.map_contains_key(permitted, k))
    return F.map_concat(kept, permitted)


def with_bodies(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """resolved with the status and body of the response that each resolved revisit refers to, else nulls."""
    spark = resolved.sparkSession
    resolved = materialize(resolved, work_path(spark, "revisits"))
    key = F.when(F.col("outcome") == "resolved", F.col("refers_to")).alias("body_of")
    wanted = resolved.select(key).where("body_of is not null").groupBy("body_of").agg(F.count(F.lit(1)).alias("n"))
    bodies = records.where(is_full()).select(F.col("record_id").alias("body_of"), "ts", "status", "body")
    bodies = bodies.join(wanted, "body_of")
    latest = F.max(F.struct("ts", "status", "body")).alias("r")
    bodies = bodies.groupBy("body_of", "n").agg(latest).select("body_of", "n", "r.status", "r.body")
    # A body isn't small, so it isn't broadcast: that of many revisits goes to as many tasks as they are dealt to.
    bound = max(1, resolved.count() // HOT_KEYS)
    hot = wanted.where(F.col("n") > bound).select("body_of", F.ceil(F.col("n") / bound).cast("int").alias("salts"))
    hot = F.broadcast(hot)  # HOT_KEYS rows at most
    salts = F.coalesce("salts", F.lit(1))
    bodies = bodies.join(hot, "body_of", "left").select(
        "body_of", "status", "body", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    )
    asking = resolved.where(key.isNotNull()).withColumn("body_of", key).join(hot, "body_of", "left")
    asking = asking.withColumn("salt", F.pmod(F.xxhash64("record_id", "ts", "url"), salts).cast("int"))
    names = [*resolved.columns, "status", "body"]
    found = asking.join(bodies, ["body_of", "salt"], "left").select(names)
    return found.unionByName(resolved.where(key.isNull()), allowMissingColumns=True)


def write_record(
    kind: str, url: str, date: str, status: int, headers: dict[str, str], body: bytes = b"", record_id: str | None = None
) -> bytes:
    """One gzip member with a response or a server-not-modified revisit."""
    http = f"HTTP/1.1 {status} {'OK' if status == 200 else 'Not Modified'}\r\n"
    http += "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    block = http.encode() + (body if kind == "response" else b"")
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id or 'urn:uuid:' + str(uuid.uuid4())}>",
        "WARC-Target-URI": url,
        "WARC-Date": date,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        fields["WARC-Profile"] = PROFILE
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n")


def _fields(stream: io.BufferedIOBase) -> dict[str, str]:
    found: dict[str, str] = {}
    last = None
    while (line := stream.readline()) and (line := line.rstrip(b"\r\n")):
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and last:
            found[last] += " " + text.strip()
        elif ":" in text:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            found[last] = value.strip()
    return found


#: What ends a record and a head. A block can hold it too.
SEPARATOR = b"\r\n\r\n"
#: What stands between records, but for the last digit of the version; parts plain files, which Spark splits.
PLAIN_SEPARATOR = SEPARATOR + b"WARC/1."
_BEGIN = re.compile(rb"WARC/\d")
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def _record(head: bytes, block: bytes, number: int) -> dict:
    fields = _fields(io.BytesIO(head))
    record = {
        "record_id": fields.get("warc-record-id", "").strip("<>") or None,
        "type": fields.get("warc-type"),
        "url": (fields.get("warc-target-uri") or "").strip("<>") or None,
        "ts": fields.get("warc-date"),
        "profile": fields.get("warc-profile"),
        "status": None,
        "headers": None,
        "body": block,
        "offset": number,
    }
    if fields.get("content-type", "").startswith("application/http") and block.startswith(b"HTTP/"):
        inner = io.BytesIO(block)
        status = inner.readline().split(b" ", 2)
        record["status"] = int(status[1]) if len(status) > 1 and status[1].isdigit() else None
        record["headers"] = _fields(inner)
        record["body"] = inner.read()
    return record


def parse_pieces(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records of a file from what SEPARATOR parts, in order; offset numbers them.

    A block that holds the separator is put together again by its Content-Length. A record without a readable length is
    left out, and so is one that is cut off at the end.
    """
    number, held, size, need, head, length = -1, [], 0, None, b"", 0
    for piece in pieces:
        if not held:
            if not _BEGIN.match(piece):
                continue
            number += 1
            held, size, need = [piece], len(piece), None
        else:
            held += [SEPARATOR, piece]
            size += len(SEPARATOR) + len(piece)
        if need is None:
            whole = held[0]
            end = _HEAD_END.search(whole)  # heads with bare line feeds
            head = whole[: end.start()] if end else whole
            told = _fields(io.BytesIO(head)).get("content-length", "")
            if not re.fullmatch("[0-9]{1,18}", told):
                held = []
                continue
            length = int(told)
            need = (end.end() if end else len(whole) + len(SEPARATOR)) + length
        if size + len(SEPARATOR) >= need:  # a separator follows each piece
            block = b"".join([*held, SEPARATOR])[need - length : need]
            held = []
            yield _record(head, block, number)


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a small WARC file that is in memory, plain or of gzip members."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return parse_pieces(iter((b"".join(out) or data).split(SEPARATOR)))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at path: those of gzip members (by their names, .gz) and plain ones.

    Files are read as a stream and go to Python in pieces, so none is ever in memory as a whole. offset numbers
    the records of a file, or of each split of a plain one (block is where the split begins). Of a damaged file what
    can be read is read. A block of a plain file that holds PLAIN_SEPARATOR just where Spark splits the file is lost.
    """

    def pieces_of(names: str, separator: bytes) -> DataFrame:
        options = {"pathGlobFilter": names, "lineSep": separator.decode(), "ignoreCorruptFiles": "true"}
        return spark.read.options(**options).text(path)

    zipped = _records(pieces_of("*.gz", SEPARATOR), b"")
    return zipped.unionByName(_records(pieces_of("*[^z]", PLAIN_SEPARATOR), PLAIN_SEPARATOR.removeprefix(SEPARATOR)))


def _records(rows: DataFrame, prefix: bytes) -> DataFrame:
    """Records from the pieces of files; prefix: what the reader took from all pieces but a file's first."""
    rows = rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )
    text = "record_id string, type string, url string, ts string, profile string, status int, headers map<string,string>, body binary, file string, block bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                *((n, pa.string()) for n in ("record_id", "type", "url", "ts", "profile")),
                ("status", pa.int32()),
                ("headers", pa.map_(pa.string(), pa.string())),
                ("body", pa.binary()),
                ("file", pa.string()),
                ("block", pa.int64()),
                ("offset", pa.int64()),
            ]
        )
        pieces = (row for batch in batches for row in zip(*(batch.column(k) for k in range(3))))
        for (file, block), own in itertools.groupby(pieces, lambda r: (r[0].as_py(), r[1].as_py())):
            found, size = [], 0
            whole = ((prefix if k or block else b"") + r[2].as_py() for k, r in enumerate(own))
            for record in parse_pieces(whole):
                headers = record["headers"]
                found.append(record | {"file": file, "block": block, "headers": headers and list(headers.items())})
                size += len(record["body"])
                if len(found) == 256 or size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)

    return map_arrow(rows, run, text).withColumn("ts", F.try_to_timestamp("ts"))

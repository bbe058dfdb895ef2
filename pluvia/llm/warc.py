"""WARC: a deterministic sharded writer, and a reader.

Records are range-sorted by page id and payload digest into shards. The shards' bounds are
keys picked by their hashes, so they, and with them all files, depend on the rows alone: not on
partitions, samples or attempts. Within a shard, files roll by compressed size, one gzip member
a record, with headers and digests made from the payload. A file is written under a temporary
name; what a task finished is listed in a manifest, which Spark commits. Only listed files are
then renamed to their final names, made of the shard, the file's number in it and the content's
digest, so a rerun or a lost executor leaves no second copy and no two files share a name. The
manifest's records are counted against the pages before the rename; a difference is an error.
The list of final names is the committed archive, and the only thing that readers look at.

Of records with equal payloads, the one with the largest page id is the response; the others
are revisits that refer to it. Their HTTP header keeps the payload's length, their body is
empty.

A null payload is empty, a null url an empty one. A null page id sorts first and is never
referred to; pages whose payload has no page with an id are all responses. Rows with equal page
ids and payloads are all responses if that id is the largest. Rows that repeat whole are records
each; they stay in one shard, whose files roll as always. Pages of one id, or without one, are
dealt over shards by their digests. Empty tables write no files. Other columns, also
of the names used here, are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.common import shared_dir, table, text_of, written

DATE = "2024-01-01T00:00:00Z"
MANIFEST = "temporary string, final string, records long, bytes long"
LISTED = pa.schema([("temporary", pa.string()), ("final", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
PIECE = 1 << 16


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header's value on one line."""
    return " ".join(value.split())


def record(page_id: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (b"" if revisit else payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(body)}"]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def plan(pages: DataFrame) -> DataFrame:
    """(page_id, mark, url, html, size, digest, refers_to): a row for each page, and a mark before each one that revisits another.

    Marks come from ids and digests alone. They meet their pages where both are range-sorted by page
    id, so that payloads move once.
    """
    html = text_of("html")
    each = pages.select(F.col("page_id").cast("long"), text_of("url").alias("url"), html.alias("html"), F.unhex(F.sha1(F.encode(html, "utf-8"))).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    ids = each.select("page_id", "digest", "size")
    last = ids.groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL").drop("n")
    last = written(last, "payloads")  # one row for each repeated payload; stored, so that the join can split one with many copies
    revisits = ids.join(last, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("last"))).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    marks = revisits.select("page_id", F.lit(0).alias("mark"), none("string").alias("url"), none("string").alias("html"), "size", "digest", F.col("last").alias("refers_to"))
    return marks.unionByName(each.select("page_id", F.lit(1).alias("mark"), "url", "html", "size", "digest", none("long").alias("refers_to")))


KEY = ("page_id", "digest")
#: Bounds of shards are one key in so many, by hash: a shard holds about this many pages, and there are about MOST_SHARDS of them at most.
SHARD_PAGES, MOST_SHARDS = 1024, 32_768


def bounds(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> tuple[list, int]:
    """The keys at which shards begin, in order, and the number of pages. Every key has the same chance, whatever the partitions."""
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(F.encode(text_of("html"), "utf-8"))).alias("digest"))
    total = keys.count()
    one_in = max(shard_pages, -(-total // MOST_SHARDS))
    picked = keys.where(F.pmod(F.xxhash64(*KEY), F.lit(one_in)) == 0).distinct().orderBy(F.col("page_id").asc_nulls_first(), "digest").collect() if total > shard_pages else []
    return [(r["page_id"], bytes(r["digest"])) for r in picked], total


def with_shard(records: DataFrame, begins: list) -> DataFrame:
    """records with the number of bounds at or before each one's key. Only keys go to Python, where the broadcast bounds (about MOST_SHARDS) are searched; payloads stay."""
    if not begins:
        return records.withColumn("shard", F.lit(0))
    given = records.sparkSession.sparkContext.broadcast([(i is not None, i or 0, d) for i, d in begins])  # nulls first, as in the order of records

    @F.arrow_udf("int")
    def shard(ids: pa.Array, digests: pa.Array) -> pa.Array:
        keys = zip(ids.to_pylist(), digests.to_pylist(), strict=True)
        return pa.array([bisect.bisect_right(given.value, (i is not None, i or 0, d)) for i, d in keys], pa.int32())

    return records.withColumn("shard", shard(*KEY))


def _filesystem(uri: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(uri)


def _write(batches, folder, roll, level):
    """Writes this task's records, shard by shard; yields a row for each finished file."""
    files, root = _filesystem(folder)
    out, temporary, shard, number, n, size, content = None, "", None, 0, 0, 0, None
    marked: dict[tuple[int | None, bytes, int], int] = {}  # what the pages of the current key refer to

    def finished():
        out.close()
        name = f"{root}/pages-{shard:05d}-{number:05d}-{content.hexdigest()[:16]}.warc.gz"
        return pa.RecordBatch.from_pylist([{"temporary": temporary, "final": name, "records": n, "bytes": size}], schema=LISTED)

    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        for i in range(batch.num_rows):  # one payload at a time
            r = {c: v[i].as_py() for c, v in columns.items()}
            key = (r["page_id"], r["digest"], r["size"])
            if not r["mark"]:
                marked = {key: r["refers_to"]}
                continue
            to = marked.get(key)
            data = gzip.compress(record(r["page_id"], r["url"], b"" if to is not None else r["html"].encode(), r["size"], base64.b32encode(r["digest"]).decode(), to, to is not None), level, mtime=0)
            if out is not None and (r["shard"] != shard or size + len(data) > roll):
                yield finished()
                out = None
            if out is None:
                number = number + 1 if r["shard"] == shard else 0
                shard, temporary = r["shard"], f"{root}/temporary/{uuid.uuid4().hex}.warc.gz"
                out, n, size, content = files.open_output_stream(temporary, compression=None), 0, 0, hashlib.sha256()
            out.write(data)
            content.update(data)
            n += 1
            size += len(data)
    if out is not None:
        yield finished()


def _commit(batches, folder):
    """Renames listed files. A second attempt finds the final name there."""
    import pyarrow.fs

    files, _ = _filesystem(folder)
    for batch in batches:
        for r in batch.to_pylist():
            if files.get_file_info(r["temporary"]).type != pyarrow.fs.FileType.NotFound:
                files.move(r["temporary"], r["final"])
            elif files.get_file_info(r["final"]).size != r["bytes"]:
                raise OSError(f"{r['final']} is missing or has another size")
        yield batch


def write(pages: DataFrame, folder: str, roll: int = 64 << 20, level: int = 6, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """Writes the archive below folder, a URI that all executors reach; returns the committed manifest."""
    spark = pages.sparkSession
    files, root = _filesystem(folder)
    files.create_dir(f"{root}/temporary", recursive=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    begins, total = bounds(pages, shard_pages)
    order = [F.col("page_id").asc_nulls_first(), "digest", "size", "mark", "url"]
    ordered = with_shard(plan(pages), begins).repartitionByRange(parts, "shard").sortWithinPartitions("shard", *order)
    ordered.mapInArrow(lambda b: _write(b, folder, roll, level), MANIFEST).write.parquet(f"{folder}/manifest-written")
    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest-written")
    records, names, rows = listed.agg(F.coalesce(F.sum("records"), F.lit(0)), F.count_distinct("final"), F.count("*")).first()
    if records != total or names != rows:
        raise OSError(f"{records} records in {rows} files of {names} names were written for {total} pages")
    listed.mapInArrow(lambda b: _commit(b, folder), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(stream):
    """The records of an archive of one gzip member each, read in pieces: what follows a member is copied, so pieces are small."""
    inflate, held = zlib.decompressobj(31), io.BytesIO()
    data = stream.read(PIECE)
    while data:
        held.write(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield held.getvalue()
            inflate, held = zlib.decompressobj(31), io.BytesIO()
        if not data:
            data = stream.read(PIECE)


def parse(data: bytes) -> dict:
    """Headers, HTTP header and payload of a record; its block digest must agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(body) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{sha1(body)}":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"fields": fields, "length": length, "payload": payload}


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(batches, folder, payloads):
    files, _ = _filesystem(folder)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for name in batch.column("final").to_pylist():
            rows = []
            with files.open_input_stream(name, compression=None) as stream:
                for data in members(stream):
                    r = parse(data)
                    f, kind = r["fields"], r["fields"]["WARC-Type"]
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (sha1(r["payload"]) != digest or len(r["payload"]) != r["length"]):
                        raise ValueError(f"payload of {f['WARC-Record-ID']} does not agree with its digest")
                    number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                    rows.append({"page_id": number("X-Page-ID"), "url": f["WARC-Target-URI"], "payload_bytes": r["length"], "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload": r["payload"] if payloads and kind == "response" else None})
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of a committed archive, checked against their digests."""
    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("final")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, "final").mapInArrow(lambda b: _read(b, folder, payloads), READ)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pluvia/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder, payloads=False).drop("payload", "url")


#: DuckDB's sha1 gives hex digits; base32 is put together from five bits at a time.
ORACLE_OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', h[i])]), '') AS bits FROM g)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5 * k + 1] AS INT) + 8 * CAST(bits[5 * k + 2] AS INT) + 4 * CAST(bits[5 * k + 3] AS INT) + 2 * CAST(bits[5 * k + 4] AS INT) + CAST(bits[5 * k + 5] AS INT)]), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM b
"""

"""WARC archives: writing, normalising monolithic gzip files, and reading back.

A crawler's archive is often one gzip stream over the whole file, in which no record can be found by itself. The
normaliser inflates such a stream once, with bounded memory, finds the records by their lengths, writes each one
as a gzip member of its own, and leaves a sidecar index with every member's offset and length.

Files go to the shared folder (any store that ``pyarrow.fs`` opens by URI). An attempt writes under a name of its
own and moves the finished file; the table of finished files is written as Parquet, so that a repeated task leaves
an unused file and changes nothing.

Cases: null html is an empty payload, a null url an empty target; null page ids are kept and never referred to as the
larger one; rows with equal page ids and payloads are all responses; a task holds one record at a time, so a very long
page needs memory for a few copies of itself; a file that ends inside a gzip member or a record, or that has
another number of records than were written, is an error; an empty table gives no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import materialize, work_path

REVISIT_BYTES = 1000
LEVEL = 3
BLOCK = 1 << 20
ARCHIVE_BYTES = 1 << 30  # compressed; a task goes on in a new file after it
SALTS = 64
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uuid(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uuid(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"WARC-X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_uuid(refers_to)}", f"WARC-Profile: {PROFILE}", f"WARC-X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])


def inflate(source) -> Iterator[bytes]:
    """The contents of a gzip file of one or more members, in blocks; the file must end where a member does."""
    z, fed = zlib.decompressobj(31), False
    while data := source.read(BLOCK):
        while data:
            out = z.decompress(data, 4 * BLOCK)
            fed = True
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z, fed = z.unused_data, zlib.decompressobj(31), False
    while fed and (out := z.decompress(z.unconsumed_tail, 4 * BLOCK)):
        yield out
    if fed and not z.eof:
        raise ValueError("the archive ends inside a gzip member")


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Cuts a stream into whole records by their Content-Length."""
    held = bytearray()
    need, body = None, 0
    for block in blocks:
        held += block
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(parse_head(bytes(held[:end]))["Content-Length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends inside a record")


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def normalise(source_uri: str, target_uri: str) -> int:
    """Rewrites a monolithic file record by record; ``target_uri + '.idx'`` gets a line "offset length" for each."""
    store, path = _open(source_uri)
    out_store, out_path = _open(target_uri)
    tag = f".{uuid.uuid4().hex}.tmp"
    n = offset = 0
    with store.open_input_stream(path, compression=None) as source, out_store.open_output_stream(out_path + tag, compression=None) as out, out_store.open_output_stream(f"{out_path}.idx{tag}", compression=None) as idx:
        for record in records(inflate(source)):
            member = gzip_member(record)
            out.write(member)
            idx.write(b"%d %d\n" % (offset, len(member)))
            offset += len(member)
            n += 1
    out_store.move(f"{out_path}.idx{tag}", f"{out_path}.idx")
    out_store.move(out_path + tag, out_path)
    return n


def read_members(uri: str) -> Iterator[bytes]:
    """The records of a normalised file, each found by its index entry."""
    store, path = _open(uri)
    with store.open_input_stream(f"{path}.idx", compression=None) as f:
        index = [tuple(map(int, x.split())) for x in f.read().decode().splitlines()]
    with store.open_input_file(path) as f:
        for offset, length in index:
            f.seek(offset)
            yield zlib.decompress(f.read(length), 31)


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of at least 1000 bytes the largest page id responds.

    Groups are decided on ids and digests alone; a payload is joined by its own page, so that no group's payloads meet in a task."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # the salt spreads pages without an id, and the members of a large group
    rows = rows.withColumn("salt", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")))
    slim = rows.where("salt is not null").select("page_id", "digest", "salt")
    partial = slim.groupBy("digest", "salt").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    groups = partial.groupBy("digest").agg(F.max("keeper").alias("keeper"), F.sum("n").alias("n")).where("n > 1 and keeper is not null")
    spread = groups.select("digest", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    revisits = slim.join(spread, ["digest", "salt"]).where(~F.col("keeper").eqNullSafe(F.col("page_id"))).select("page_id", "digest", "salt", "keeper").distinct()
    r, v = rows.alias("r"), revisits.alias("v")
    on = [F.col("r.page_id").eqNullSafe(F.col("v.page_id")), F.col("r.digest") == F.col("v.digest"), F.col("r.salt") == F.col("v.salt")]
    return r.join(v, on, "left").select("r.page_id", "r.url", "r.payload", "r.digest", F.col("v.keeper").alias("refers_to"))


def write_archives(pages: DataFrame, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes each task's pages as monolithic gzip WARC files; returns the table of files (uri, n)."""
    import pyarrow as pa

    folder = work_path(pages.sparkSession, "warc")

    def run(batches: Iterator) -> Iterator:
        out = None

        def finished() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            store.move(path + ".tmp", path)
            return pa.RecordBatch.from_pydict({"uri": [uri], "n": pa.array([n], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    z, n, uri = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, f"{folder}/whole-{uuid.uuid4().hex}.warc.gz"
                    store, path = _open(uri)
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(path + ".tmp", compression=None)
                page_id, url, payload, digest, refers = (batch.column(k)[i].as_py() for k in range(5))
                out.write(z.compress(make_record(page_id, url, payload, digest, refers)))
                n += 1
                if out.tell() >= archive_bytes:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    rows = with_revisits(pages).select("page_id", "url", "payload", "digest", "refers_to")
    return materialize(rows.mapInArrow(run, "uri string, n long"), "archives")


def normalise_archives(files: DataFrame) -> DataFrame:
    """Normalises every file of the table; returns (uri, n) of the rewritten files."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for uri, written in zip(*(c.to_pylist() for c in batch.columns)):
                target = uri.replace("/whole-", "/records-")
                n = normalise(uri, target)
                if n != written:
                    raise ValueError(f"{uri} has {n} records of {written}")
                yield pa.RecordBatch.from_pydict({"uri": [target], "n": pa.array([n], pa.int64())})

    return materialize(_one_each(files).mapInArrow(run, "uri string, n long"), "normalised")


def _one_each(files: DataFrame) -> DataFrame:
    """The table of files with about one file in each partition."""
    return files.select("uri", "n").repartitionByRange(max(files.count(), 1), "uri")


def read_archives(files: DataFrame) -> DataFrame:
    """One row for each record, from its own bytes: page id, payload size and digest, type, page referred to."""
    import pyarrow as pa

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def row(record: bytes) -> tuple:
        end = record.index(b"\r\n\r\n")
        head = parse_head(record[:end])
        body = record[end + 4 : -4]
        http, payload = body.split(b"\r\n\r\n", 1)
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        size = int(http.rsplit(b"Content-Length: ", 1)[1])
        if head["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError("a record's payload differs from its digest")
        number = lambda name: int(head[name]) if name in head else None
        return number("WARC-X-Page-ID"), size, digest, head["WARC-Type"], number("WARC-X-Refers-To-Page-ID")

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for uri, written in zip(*(c.to_pylist() for c in batch.columns)):
                held, n = [], 0
                for record in read_members(uri):
                    held.append(row(record))
                    n += 1
                    if len(held) == 4096:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)
                if n != written:
                    raise ValueError(f"{uri} has {n} records of {written}")

    def _batch(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _one_each(files).mapInArrow(run, schema)


def op6_query(spark, sf_dir: str) -> DataFrame:
    from chronolith.llm.common import table

    return read_archives(normalise_archives(write_archives(table(spark, sf_dir, "pages"))))


OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS b, sha1(h) AS s FROM p),
k AS (SELECT s, max(page_id) AS keeper FROM d WHERE b >= {REVISIT_BYTES} GROUP BY s)
SELECT d.page_id, d.b::BIGINT AS payload_bytes, d.s AS payload_digest,
  CASE WHEN d.b >= {REVISIT_BYTES} AND k.keeper <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.b >= {REVISIT_BYTES} AND k.keeper <> d.page_id THEN k.keeper END AS refers_to
FROM d LEFT JOIN k ON k.s = d.s
"""

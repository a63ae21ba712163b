"""WARC archives in which equal payloads are kept once.

Headers alone are shuffled by payload digest: grouped (greatest id for each, partial before the shuffle) to find the record that keeps the payload, and
joined to that. Payloads meet what was found by their page, so a payload that a third of all pages have gathers nowhere. The others are written as
revisits that refer to the keeper. Archives are gzip members, one for each record, in files beside Spark's own in the shared
folder. What a lost or repeated task wrote is never read: the table of files that Spark commits names the valid ones.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillgraph.llm.common import open_fs, partitions, rows, scratch, table

#: Smaller payloads are never revisited.
LEAST_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space of URLs


def record_id(page: int | None, uri: str | None, digest: str) -> str:
    """A record's own identity: that of its page, address and payload."""
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page} {uri} {digest}')}>"


def _headers(pairs: list[tuple[str, object]]) -> bytes:
    # a header's value holds no line breaks
    return "".join(f"{k}: {' '.join(str(v).splitlines())}\r\n" for k, v in pairs if v is not None).encode("utf-8", "surrogatepass") + b"\r\n"


def record(page: int | None, uri: str | None, payload: bytes, date: str, keeper: tuple[int, str | None] | None) -> bytes:
    """A response record with its payload, or, with the page that keeps it, a revisit without."""
    sha = hashlib.sha1(payload)
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if keeper else http + payload
    labelled = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
    head = [("WARC-Type", "revisit" if keeper else "response"), ("WARC-Record-ID", record_id(page, uri, sha.hexdigest())), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    if keeper:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*keeper, sha.hexdigest())), ("WARC-Refers-To-Target-URI", keeper[1]), ("WARC-Refers-To-Date", date)]
    head += [("X-Page-ID", page), ("WARC-Payload-Digest", labelled(sha)), ("WARC-Block-Digest", labelled(hashlib.sha1(block)))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + _headers(head) + block + b"\r\n\r\n"


def _zipped(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def members(source) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    held = b""
    while held or (held := source.read(1 << 20)):
        opened, out = zlib.decompressobj(31), io.BytesIO()
        while not opened.eof:
            if not held and not (held := source.read(1 << 20)):
                raise ValueError("an archive ends within a record")
            out.write(opened.decompress(held))
            held = b"" if not opened.eof else opened.unused_data
        yield out.getvalue()


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, by lower-case name, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is not what it says")
    return headers, rest[:n]


def resolved(pages: DataFrame, id_col: str, uri_col: str, html_col: str) -> DataFrame:
    """(page, uri, html, keeper_page, keeper_uri); the keeper is null for pages that keep their own payload."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    given = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{uri_col}`").cast("string").alias("uri"), html.alias("html"))
    given = given.select("page", "uri", "html", F.when(F.octet_length("html") >= LEAST_BYTES, F.sha1(F.encode("html", "UTF-8"))).alias("digest"))
    # headers only: the greatest page of each digest that several pages have
    same = given.filter("digest is not null and page is not null").groupBy("digest").agg(F.max(F.struct("page", "uri")).alias("k"), F.count("*").alias("n"))
    same = same.filter("n > 1").select(F.col("digest").alias("d"), F.col("k.page").alias("keeper_page"), F.col("k.uri").alias("keeper_uri"))
    headers = given.filter("digest is not null and page is not null").select("page", "digest").distinct()
    revisits = headers.join(same, F.col("digest") == F.col("d")).filter("page <> keeper_page").select(F.col("page").alias("p"), "d", "keeper_page", "keeper_uri")
    both = given.join(revisits, (F.col("page") == F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return both.select("page", "uri", "html", "keeper_page", "keeper_uri")


def write(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write an archive for each task; a row (uri, records) for each.

    A null html is an empty payload, a null address is left out. Of pages with equal payloads of LEAST_BYTES bytes or more,
    that with the largest id keeps it (rows that repeat this id keep theirs too); a page without id always keeps its own. Payloads are written whole, one
    record at a time, however long. An empty table gives archives without records or none. Other columns are not read, whatever their names.
    """
    folder = scratch(pages.sparkSession, "warc")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        where, path = open_fs(f"{folder}/{name}")
        where.create_dir(path.rpartition("/")[0], recursive=True)
        n = 0
        with where.open_output_stream(path, compression=None) as stream:
            for held in rows(batches):
                for page, uri, html, keeper_page, keeper_uri in held:
                    keeper = None if keeper_page is None else (keeper_page, keeper_uri)
                    stream.write(_zipped(record(page, uri, html.encode("utf-8", "surrogatepass"), date, keeper)))
                    n += 1
        yield pa.RecordBatch.from_pydict({"uri": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

    return table(resolved(pages, id_col, uri_col, html_col).mapInArrow(written, "uri string, records long"), "archives")


def read(archives: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A row for each record: id, payload_bytes, payload_digest, record_type, refers_to (the id of the page referred to).

    No archives, or empty ones, give no rows; a record is read whole, one at a time. Digests and lengths of responses are checked against their payloads; those of revisits are what their headers say. Revisits are
    joined to the responses that they refer to by record id.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                out = []
                where, path = open_fs(uri)
                with where.open_input_stream(path, compression=None) as source:
                    for data in members(source):
                        out.append(_row(*parsed(data)))
                        if len(out) == 10_000:
                            yield _listed(out)
                            out = []
                yield _listed(out)

    found = archives.filter("records > 0").select("uri").repartition(partitions(archives.sparkSession)).mapInArrow(listed, LISTED)
    found = table(found, "records")
    kept = found.filter("kind = 'response'").groupBy("record").agg(F.max("page").alias("kept_page")).withColumnRenamed("record", "r")
    # only responses that are referred to have rows to be joined with
    known = found.filter("kind = 'revisit'").join(kept, F.col("refers") == F.col("r"), "left").drop("r")
    rows_ = found.filter("kind = 'response'").withColumn("kept_page", F.lit(None).cast("long")).unionByName(known)
    return rows_.select(F.col("page").alias(id_col), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("kept_page").alias("refers_to"))


LISTED = "page long, payload_bytes long, payload_digest string, kind string, record string, refers string"


def _row(headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    n = int(head.lower().rpartition(b"content-length: ")[2])
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = headers["warc-type"]
    if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (n, digest):
        raise ValueError("a payload is not what its record says")
    page = headers.get("x-page-id")
    return page and int(page), n, digest, kind, headers["warc-record-id"], headers.get("warc-refers-to")


def _listed(out: list[tuple]) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[]] * 6
    kinds = (pa.int64(), pa.int64(), *(pa.string(),) * 4)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in LISTED.split(", ")])

"""WARC archives: index first, then coalesced byte-range reads.

``write_warc`` writes one archive per task (every record a gzip member of its
own) and returns the index: file, offset, length, url, digest of each record.
``read_warc`` sorts the selected index rows by file and offset, joins ranges
that lie close together into one read each, and parses the records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.llm.common import materialise, query, shared_path, table

#: Payloads shorter than this are always written in full.
MIN_REVISIT_BYTES = 1000
#: Ranges of one file at most this far apart are read at once, up to ``MAX_READ`` bytes.
MAX_GAP, MAX_READ = 64 << 10, 8 << 20
GZIP_LEVEL = 4
#: Header fields of our own: the page of a record, and the page that a revisit refers to.
PAGE_ID, REFERS_TO = "X-Page-ID", "X-Refers-To-Page-ID"
CRLF = b"\r\n"

INDEX_SCHEMA = ("page_id bigint, url string, digest string, record_type string, refers_to bigint, file string, "
                "offset bigint, length bigint")
RECORD_SCHEMA = ("page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
                 "payload_bytes bigint, payload binary")


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to.

    Of pages with equal payloads of ``MIN_REVISIT_BYTES`` or more the one with
    the largest page_id is the response (repeated rows of that page too) and
    the others revisit it. A null page_id counts as smaller than any other; if
    all are null, all are responses. Only digests met twice or more are joined
    back; Spark broadcasts them if they are few and splits hot ones if not.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    groups = (pages.select("page_id", F.sha1(html.cast("binary")).alias("g_digest"),
                           F.octet_length(html).alias("n_bytes"))
              .filter(F.col("n_bytes") >= MIN_REVISIT_BYTES)
              .groupBy("g_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
              .filter("n > 1").select("g_digest", "response"))
    joined = known.join(groups, known["digest"] == groups["g_digest"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.select("page_id", "url", "html", "digest",
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("response")).alias("refers_to"))


def record_id(page_id: int | str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def render_record(page_id, url, html, digest, record_type, refers_to, date) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers, and with them the payload's length, but no payload."""
    payload = html.encode("utf-8")
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if record_type == "revisit" else http + payload
    head = [f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"{PAGE_ID}: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to, digest)}", f"{REFERS_TO}: {refers_to}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("utf-8") + CRLF + CRLF + block + CRLF + CRLF


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload); names in lower case."""
    head, _, rest = raw.partition(CRLF + CRLF)
    warc = _headers(head)
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    return warc, _headers(http), payload


def pages_of(warc: dict[str, str], digest: str) -> tuple[str | None, str | None]:
    """(page_id, refers_to) as a record's headers give them; ValueError if its record ids are not those of these pages."""
    page, refers = warc.get(PAGE_ID.lower()), warc.get(REFERS_TO.lower())
    wanted = record_id(refers, digest) if warc["warc-type"] == "revisit" else None
    if warc["warc-record-id"] != record_id(page, digest) or warc.get("warc-refers-to") != wanted:
        raise ValueError(f"record {warc['warc-record-id']} does not belong to page {page}")
    return page, refers


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8").split("\r\n")[1:])
    return {name.lower(): value.strip() for name, _, value in pairs}


def write_warc(marked: DataFrame, root: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of :func:`mark_revisits` below ``root`` (a shared folder) and return the index.

    The index is written before it is returned, so archives are made once. A
    task that runs again writes a file of its own and only the index rows of the
    attempt that counted survive.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, folder = pafs.FileSystem.from_uri(root)
        filesystem.create_dir(folder, recursive=True)
        context = TaskContext.get()
        file = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        offset, out = 0, None
        try:
            for pdf in batches:
                rows = []
                for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                    out = out or filesystem.open_output_stream(file, compression=None)
                    gzip = zlib.compressobj(GZIP_LEVEL, wbits=31)
                    page_id = None if r.page_id is None else int(r.page_id)
                    refers_to = None if r.refers_to is None else int(r.refers_to)
                    raw = render_record(page_id, r.url, r.html, r.digest, r.record_type, refers_to, date)
                    data = gzip.compress(raw) + gzip.flush()
                    out.write(data)
                    rows.append((page_id, r.url, r.digest, r.record_type, refers_to, file, offset, len(data)))
                    offset += len(data)
                frame = pd.DataFrame(rows, columns=["page_id", "url", "digest", "record_type", "refers_to", "file",
                                                    "offset", "length"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    # ids cross as text: a nullable bigint would pass through pandas as a double
    ids = marked.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return materialise(ids.mapInPandas(write, INDEX_SCHEMA), "warc-index")


def coalesce_ranges(ranges: list[tuple[str, int, int]], max_gap: int = MAX_GAP,
                    max_read: int = MAX_READ) -> list[tuple[str, int, int, list[int]]]:
    """Reads (file, start, end, positions in ``ranges``) that cover sorted (file, offset, length) ranges."""
    reads: list[tuple[str, int, int, list[int]]] = []
    for i, (file, offset, length) in enumerate(ranges):
        if reads:
            last, start, end, own = reads[-1]
            if file == last and offset - end <= max_gap and max(end, offset + length) - start <= max_read:
                own.append(i)
                reads[-1] = (last, start, max(end, offset + length), own)
                continue
        reads.append((file, offset, offset + length, [i]))
    return reads


def read_warc(index: DataFrame, root: str) -> DataFrame:
    """The records of the selected ``index`` rows; ``payload`` is null for a revisit.

    Rows are range-partitioned by (file, offset), so tasks read neighbouring
    bytes and no file, however large, is bound to one task. All but the url
    (whose line ends are escaped in a record) comes from the archive: page_id and
    refers_to are read from the record and held against its record ids. A record
    whose payload does not fit its digest raises an error.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, _ = pafs.FileSystem.from_uri(root)
        for pdf in batches:
            ranges = list(zip(pdf["file"], pdf["offset"].tolist(), pdf["length"].tolist(), strict=True))
            urls = pdf["url"].tolist()
            for file, start, end, own in coalesce_ranges(ranges):
                with filesystem.open_input_file(file) as source:
                    data = source.read_at(end - start, start)
                rows = []
                for i in own:
                    at = ranges[i][1] - start
                    warc, http, payload = parse_record(zlib.decompress(data[at:at + ranges[i][2]], wbits=31))
                    digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{file} at {ranges[i][1]}: payload does not fit its digest")
                    page, refers = pages_of(warc, digest)
                    size = len(payload) if kind == "response" else int(http["content-length"])
                    rows.append((page, urls[i], kind, refers, digest, size,
                                 payload if kind == "response" else None))
                yield pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_digest",
                                                  "payload_bytes", "payload"])

    schema = RECORD_SCHEMA.replace("page_id bigint", "page_id string").replace("refers_to bigint", "refers_to string")
    ordered = (index.select("file", "offset", "length", "url")
               .repartitionByRange("file", "offset").sortWithinPartitions("file", "offset"))
    return ordered.mapInPandas(read, schema).withColumns(
        {c: F.col(c).cast("bigint") for c in ("page_id", "refers_to")})


def archive_pages(pages: DataFrame, root: str) -> DataFrame:
    """Index of archives of every row of ``pages`` (page_id, url, html).

    Null html is an empty payload; a null url is left out of the record. Other
    columns are not read. An empty table gives an empty index and no file.
    """
    return write_warc(mark_revisits(pages), root)


@query("op2_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> top THEN top END AS refers_to
FROM r""")
def op2_warc(spark, sf_dir):
    root = shared_path(spark, "warc")
    index = archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), root)
    return read_warc(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

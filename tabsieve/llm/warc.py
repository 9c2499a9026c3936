"""WARC archives, index first.

Writing: records are grouped by payload digest into one response and its revisits, then each task
appends its records, one gzip member each, to an archive of its own in a shared folder and returns one
index row per record: archive, offset, length, URL, digest.  The index is written as a table through
Spark and is the only way to a record: an archive left by a failed or repeated task is in no index row.

Reading: the selected index rows are dealt out by archive and slice of offsets, sorted, and read in byte
ranges; ranges closer than ``GAP`` are read as one, up to ``READ`` bytes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve._ship import ship_by_value
from tabsieve.llm.common import lookup, materialise, scratch_path

#: an archive is closed when it passes this size
ARCHIVE_BYTES = 256 << 20
#: records of an archive, whose index rows the task holds until it is closed; tasks of a reading job
ARCHIVE_ROWS, MOST_TASKS = 50_000, 100_000
GAP, READ = 64 << 10, 8 << 20
#: offsets of one archive are read in slices of this size, so no archive is one task's work
SLICE = 32 << 20
INDEX = "archive string, offset long, length long, id long, url string, digest string, record_type string, refers_to long, payload_bytes long"
RECORD = "id long, url string, payload binary, digest string, record_type string, refers_to long, payload_bytes long, intact boolean"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(row: dict) -> bytes:
    """One WARC/1.1 record; a missing id or URL leaves its header out."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"]
    kind = "application/http;msgtype=response" if revisit else "text/html; charset=utf-8"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Payload-Digest: sha1:{row['digest']}",
            f"X-Payload-Length: {row['payload_bytes']}", f"Content-Type: {kind}", f"Content-Length: {len(payload)}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in row["url"]))
    if row["id"] is not None:
        head.append(f"X-Page-ID: {row['id']}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _parsed(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    payload = rest[:int(fields["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(payload):] != b"\r\n\r\n":
        raise ValueError("not a WARC record at this offset")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    refers = fields.get("WARC-Refers-To", "<urn:page:>")[len("<urn:page:"):-1]
    response = fields["WARC-Type"] == "response"
    return {"id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, "url": fields.get("WARC-Target-URI"),
            "payload": payload if response else None, "digest": payload_digest(payload) if response else digest,
            "record_type": fields["WARC-Type"], "refers_to": int(refers) if refers else None,
            "payload_bytes": len(payload) if response else int(fields["X-Payload-Length"]),
            "intact": not response or payload_digest(payload) == digest}


def with_revisits(df: DataFrame, id_col: str, payload_col: str, smallest: int = 0) -> DataFrame:
    """Adds ``sha1`` (hex), ``payload_bytes``, ``record_type`` and ``refers_to``.  Of rows with equal payloads of at least
    ``smallest`` bytes, those with the largest id are responses and the others revisit that id; all smaller
    ones are responses.  Rows repeated with the largest id are all responses; a row without id revisits
    any id there is.  Equal payloads meet as digests and ids only, never as a group of payloads."""
    hashed = df.withColumn("payload_bytes", F.length(payload_col).cast("long")).withColumn("sha1", F.sha1(payload_col))
    largest = (hashed.where(F.col("payload_bytes") >= smallest).groupBy("sha1")
               .agg(F.max(id_col).alias("__largest"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    # only repeated digests, counted: broadcast, or with a hot digest's pages spread over salts
    joined = lookup(hashed, materialise(largest, "warc-repeated"), "sha1", F.monotonically_increasing_id())
    revisit = F.col("__largest").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__largest"))
    return (joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col("__largest"))).drop("__largest"))


_INDEX_SCHEMA = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("id", pa.int64()),
                           ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()),
                           ("refers_to", pa.int64()), ("payload_bytes", pa.int64())])
_RECORD_SCHEMA = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                            ("intact", pa.bool_())])


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pafs.FileSystem.from_uri(folder)
        out, name, size, rows = None, "", 0, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}
                row["digest"] = base64.b32encode(bytes.fromhex(row.pop("sha1"))).decode()
                if out is None:  # a name of its own for every attempt of every task
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = filesystem.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(_record(row)) + packer.flush()
                out.write(member)
                rows.append({"archive": name, "offset": size, "length": len(member)}
                            | {c: row[c] for c in _INDEX_SCHEMA.names[3:]})
                size += len(member)
                if size >= ARCHIVE_BYTES or len(rows) >= ARCHIVE_ROWS:  # index rows leave the task only after their archive is closed
                    out.close()
                    yield pa.RecordBatch.from_pylist(rows, schema=_INDEX_SCHEMA)
                    out, rows = None, []
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist(rows, schema=_INDEX_SCHEMA)
    return write


def _folder_uri(path: str) -> str:
    """A checkpoint path as a URI (``file:/x`` and bare paths become ``file:///x``)."""
    path = path.removeprefix("file:") if not path.startswith("file://") else path
    return path if "://" in path else "file:///" + path.lstrip("/")


def write_archives(df: DataFrame, id_col: str, url_col: str, payload_col: str, smallest: int = 0,
                   folder: str | None = None) -> tuple[DataFrame, str]:
    """Write a record per row of ``df``; returns ``(index, folder)``.

    ``payload_col`` is text (stored as UTF-8) or binary; null counts as empty.  A null id or URL is left
    out of the record's headers.  Repeated rows each get a record; an empty table writes no archive and
    an empty index; other columns are ignored.  ``folder`` is a shared folder (any file system that
    pyarrow opens by URI), below the cluster's checkpoint folder if not given."""
    folder = _folder_uri(folder or scratch_path(df.sparkSession, "warc"))
    filesystem, root = pafs.FileSystem.from_uri(folder)
    filesystem.create_dir(root, recursive=True)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                     F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    marked = (with_revisits(rows, "id", "payload", smallest)
              .withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))))
    index = marked.mapInArrow(_writer(folder), INDEX)
    return materialise(index, "warc-index"), folder  # written once: a second run would make other archives


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pafs.FileSystem.from_uri(folder)
        name, source, ranges = None, None, []  # ranges of one archive that are read as one

        def fetched() -> pa.RecordBatch:
            first, end = ranges[0][0], max(o + n for o, n in ranges)
            block = source.read_at(end - first, first)
            found = [_parsed(zlib.decompress(block[o - first:o - first + n], 31)) for o, n in ranges]
            return pa.RecordBatch.from_pylist(found, schema=_RECORD_SCHEMA)

        for batch in batches:
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                apart = ranges and (archive != name or offset - sum(ranges[-1]) > GAP or offset + length - ranges[0][0] > READ)
                if apart:
                    yield fetched()
                    ranges = []
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, filesystem.open_input_file(f"{root}/{archive}")
                ranges.append((offset, length))
        if ranges:
            yield fetched()
            source.close()
    return read


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` (any selection of its rows) points to: ``id, url, payload, digest,
    record_type, refers_to, payload_bytes, intact``.  A revisit has no payload of its own: ``payload`` is null,
    and digest and length are the revisited payload's.  ``intact`` says that a response's bytes have the
    digest written with them.  A row selected twice is read twice; no rows give no records."""
    slices = index.select("archive", "offset", "length", F.floor(F.col("offset") / SLICE).alias("slice"))
    # a stated number of partitions, which are not merged by the size of the index rows: it says nothing of the archives'
    tasks = min(MOST_TASKS, max(1, slices.select("archive", "slice").distinct().count()))
    dealt = slices.repartition(tasks, "archive", "slice").sortWithinPartitions("archive", "offset")
    return dealt.select("archive", "offset", "length").mapInArrow(_reader(folder), RECORD)


ship_by_value(__name__)

"""Digest files as WARC archives, read back to a capture index that is merged from sorted runs."""

import base64
import gzip
import hashlib
import re
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.batches import texts
from marginalia.operators.stored import stored

# Bytes of payload an archive is meant to hold.
ARCHIVE_BYTES = 16 << 20
# Index rows that one task merges, and rows of a batch it returns.
ROWS_PER_RANGE, ROWS_PER_BATCH = 200_000, 10_000

# Fixed values of the format.
VERSION = "WARC/1.1"
BREAK = "\r\n"
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Characters of a URI that stay as they are; control characters, blanks and the percent sign do not.
URI_SAFE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%")

SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
AUTHORITY = re.compile(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?", re.S)

INDEX = ("url_key string, written_at timestamp, doc_id long, file_name string, record_type string, refers_to long, "
         "payload_bytes long, payload_digest string, archive string, offset long, length long")
COLUMNS = [c.split()[0] for c in INDEX.split(", ")]


def write_archives(digests: DataFrame, folder: str) -> None:
    """Write a record for each row of digests (doc_id, file_name, markdown, written_at) to gzipped WARC
    files in a new folder.

    Of rows with equal markdown the one with the largest doc_id becomes a response with the whole text, the
    others revisits of it; rows that repeat this doc_id are all responses. Null markdown counts as empty. A
    null doc_id is the smallest, and named `none` in the archive. Null file_name and written_at are left out
    of the record. Other columns are ignored.
    """
    rows = digests.select("doc_id", F.struct("written_at", "file_name").alias("own"),
                          F.coalesce("markdown", F.lit("")).alias("markdown"))
    rows = rows.withColumn("identity", F.sha2("markdown", 256))
    kept = stored(rows.groupBy("identity").agg(
        F.max(F.struct("doc_id", "own")).alias("kept"), F.sum(F.octet_length("markdown")).alias("bytes"),
        F.count("*").alias("rows")))
    total = kept.agg(F.sum("bytes")).first()[0] or 0
    repeated = stored(kept.where("rows > 1").select("identity", "kept"))  # often few, and then no text moves to meet them
    first = F.col("kept").isNull() | F.col("doc_id").eqNullSafe(F.col("kept.doc_id"))
    records = (rows.join(repeated, "identity", "left")
               .select("doc_id", "own.*", "markdown",
                       F.when(~first, F.col("kept")).alias("kept"))
               .repartition(max(1, -(-total // ARCHIVE_BYTES)), F.xxhash64("doc_id", "file_name")))
    (records.select("doc_id", "file_name", F.date_format("written_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), "markdown",
                    F.col("kept").isNotNull().alias("again"), F.col("kept.doc_id").alias("of_doc"),
                    F.col("kept.own.file_name").alias("of_name"),
                    F.date_format("kept.own.written_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("of_date"))
     .mapInArrow(_records, "value string")
     .write.option("lineSep", END.decode()).option("compression", "gzip").text(folder))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """An index row for each record below the folder, sorted within an archive; payload digests are checked.

    Columns: url_key, written_at, doc_id, file_name, record_type, refers_to (doc_id of the response a
    revisit names), payload_bytes and payload_digest of the full text, and archive, offset and length of the
    record in the unpacked archive.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(_index_runs, INDEX)


def merge_captures(index: DataFrame) -> DataFrame:
    """Index rows in the order of url_key, written_at and doc_id, numbered by an increasing `position`.

    Each archive's rows are a sorted run. A range of keys goes to one task, which merges what each run has
    of it with a loser tree. Keys that many rows share are cut by time and doc_id, so a range stays small.
    Nulls come first.
    """
    index = stored(index)
    ranges = max(1, -(-index.count() // ROWS_PER_RANGE))
    return (index.repartitionByRange(ranges, "url_key", "written_at", "doc_id")
            .mapInArrow(_merge, INDEX + ", position long"))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(uri: str | None) -> str:
    """Sortable key of a URI: host labels from the right, then path and query; without scheme, user, www, the usual
    port and fragment. What has no host is its own key in lower case. Any text has one, however odd its host.
    """
    own = (uri or "").strip()
    scheme, mark, rest = own.partition("//")
    if not mark or scheme and not SCHEME.fullmatch(scheme):
        return own.lower()
    host, path, query = AUTHORITY.fullmatch(rest).groups()
    host = host.rpartition("@")[2].lower().removesuffix(":80").removesuffix(":443").removeprefix("www.")
    if not host:
        return own.lower()
    query = "?" + "&".join(sorted(query.split("&"))) if query else ""
    labels = [host] if host.startswith("[") else reversed(host.split("."))
    return ",".join(labels) + ")" + (path.rstrip("/") + query).lower()


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{TaskContext.get().partitionId()}>"),
                    ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")],
                   "format: WARC File Format 1.1" + BREAK)
    started = False
    for batch in batches:
        found = [] if started else [info]
        started = True
        for row, payload in zip(batch.drop_columns(["markdown"]).to_pylist(), texts(batch["markdown"]), strict=True):
            found.append(_capture(row, payload or b""))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["value"])


def _capture(row: dict, payload: bytes) -> str:
    head = [("WARC-Type", "revisit" if row["again"] else "response"), ("WARC-Record-ID", _name(row["doc_id"])),
            ("WARC-Date", row["date"]), ("WARC-Target-URI", _uri(row["file_name"])),
            ("WARC-Payload-Digest", "sha1:" + payload_digest(payload))]
    if row["again"]:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(row["of_doc"])),
                 ("WARC-Refers-To-Target-URI", _uri(row["of_name"])), ("WARC-Refers-To-Date", row["of_date"])]
    head.append(("Content-Type", "application/http;msgtype=response"))
    http = BREAK.join(["HTTP/1.1 200 OK", "Content-Type: text/plain;charset=utf-8", f"Content-Length: {len(payload)}", "", ""])
    return _record(head, http + ("" if row["again"] else payload.decode()))


def _record(head: list[tuple[str, str | None]], block: str) -> str:
    """A record but for the two line breaks at its end, which the writer adds."""
    lines = [VERSION, *(f"{name}: {value}" for name, value in head if value is not None),
             f"Content-Length: {len(block.encode())}", "", block]
    return BREAK.join(lines)


def _name(doc_id: int | None) -> str:
    return f"<urn:document:{'none' if doc_id is None else doc_id}>"


def _uri(file_name: str | None) -> str | None:
    return None if file_name is None else quote(file_name, safe=URI_SAFE)


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, named fields, block) of each record of an archive."""
    at = 0
    while at < len(content):
        start = content.index(END, at) + len(END)
        version, *lines = content[at:start - len(END)].decode().split(BREAK)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        end = start + int(fields["Content-Length"])
        if content[end:end + len(END)] != END:
            raise ValueError(f"the record at {at} does not end")
        yield at, end + len(END) - at, fields, content[start:end]
        at = end + len(END)


def _index_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            archive = path.rpartition("/")[2]
            run = [_index_row(archive, *record) for record in parse(gzip.decompress(content.as_py()))
                   if record[2]["WARC-Type"] in ("response", "revisit")]
            yield _table(sorted(run, key=_order), INDEX_SCHEMA)


def _index_row(archive: str, offset: int, length: int, fields: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(END)
    size = int(http.rpartition(b": ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload), payload_digest(payload)) != (size, digest):
        raise ValueError(f"{archive}: the payload at {offset} is not what was written")
    uri = fields.get("WARC-Target-URI")
    date = fields.get("WARC-Date")
    file_name = None if uri is None else unquote(uri)
    return (url_key(file_name), date and datetime.fromisoformat(date), _doc_id(fields["WARC-Record-ID"]), file_name,
            fields["WARC-Type"], _doc_id(fields.get("WARC-Refers-To")), size, digest, archive, offset, length)


def _doc_id(name: str | None) -> int | None:
    given = (name or "none>").rpartition(":")[2].removesuffix(">")
    return None if given == "none" else int(given)


def _order(row: tuple) -> tuple:
    """Sorts by url_key, written_at, doc_id, nulls first."""
    key, date, doc_id = row[:3]
    return key, date is not None, date or EPOCH, doc_id is not None, doc_id or 0


EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
INDEX_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}[t])
                          for n, t in (c.split() for c in INDEX.split(", "))])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        columns = [batch[c].to_pylist() for c in COLUMNS]
        for row in zip(*columns, strict=True):
            runs.setdefault(row[COLUMNS.index("archive")], []).append(row)
    for run in runs.values():
        run.sort(key=_order)  # in order already unless a shuffle came in several parts
    schema = INDEX_SCHEMA.append(pa.field("position", pa.int64()))
    position, held = TaskContext.get().partitionId() << 33, []
    for row in merged(list(runs.values())):
        held.append((*row, position))
        position += 1
        if len(held) == ROWS_PER_BATCH:
            yield _table(held, schema)
            held = []
    yield _table(held, schema)


class Head(NamedTuple):
    """First row of a run that is not yet merged; an exhausted run's comes after all others."""
    over: bool
    order: tuple
    run: int


def merged(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Rows of sorted runs in order, by a loser tree: inner nodes keep who lost there, the winner goes up."""
    places = [0] * len(runs)

    def head(run: int) -> Head:
        over = places[run] == len(runs[run])
        return Head(over, () if over else _order(runs[run][places[run]]), run)

    losers: list[Head | None] = [None] * len(runs)

    def play(contender: Head, node: int) -> Head | None:
        """Up from a leaf; while the tree fills, the first to reach a node waits there."""
        while node:
            waiting = losers[node]
            if waiting is None:
                losers[node] = contender
                return None
            if waiting < contender:
                losers[node], contender = contender, waiting
            node //= 2
        return contender

    winner = None
    for run in range(len(runs)):
        winner = play(head(run), (run + len(runs)) // 2) or winner
    while winner and not winner.over:
        run = winner.run
        yield runs[run][places[run]]
        places[run] += 1
        winner = play(head(run), (run + len(runs)) // 2)

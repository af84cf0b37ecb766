"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

The writer makes one gzip member of each record and leaves the files to Spark's text sink, whose
separator is one zero byte. A member ends with its data's length in little-endian bytes, of which the last
is zero below 16 MiB; that byte is left to the separator, so that members stand side by side.
Behind a longer record there is one zero byte of padding, which gzip readers skip. The reader
splits files into byte ranges. A task looks for the gzip magic in its range, takes a place for
a member if its data decode to a WARC header, and owns the records that start inside its range,
reading beyond the range's end where the last one needs it. Each byte is read once. What a task took for a
record inside one that began in an earlier range goes afterwards, by where the records of that range end.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chirplake.llm.batches import pieces
from chirplake.llm.store import discard, frozen, hadoop, joined

GZIP_MAGIC = b"\x1f\x8b\x08"
READ_BYTES = 1 << 18
RECORD_ID = "urn:page:"
#: How a record of a plain file begins, what ends a head and a record, and the bytes a head has at most.
PLAIN_MARK, GAP, MOST_HEAD = b"WARC/1.", b"\r\n\r\n", 1 << 20


def record(kind: str, page_id: int | None, url: str | None, refers_to: int | None, payload: bytes | None, digest: str, payload_bytes: int) -> bytes:
    """A record as WARC/1.1 text; a revisit has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload or b"") if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([] if url is None else [f"WARC-Target-URI: {' '.join(url.split())}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        *([f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def information() -> bytes:
    """The record that begins each file."""
    block = b"software: chirplake\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member, without its last byte where that is zero."""
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return (gz.compress(data) + gz.flush()).removesuffix(b"\0")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = True
    for piece in pieces(batches, "html"):
        out = [member(information())] if first else []
        first = False
        for page_id, url, html, refers_to, kind, size in zip(*[piece.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to", "kind", "size")], strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            out.append(member(record(kind, page_id, url, refers_to, payload, digest, size)))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes page_id, url and html of every row as a record under path, in files that end in .warc.gz.

    Of pages with equal payloads of at least least_bytes, that with the largest page_id is the
    response and the others revisit it; rows that share this page_id are all responses. A null
    html is an empty payload. Null page ids come last in that order; where all are null, all are responses.
    Other columns are ignored, whatever their names; an empty table gives a folder without records. The driver renames the files when all
    are written, which a store without renames does by copying.
    """
    html = F.coalesce("html", F.lit(""))
    named = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).alias("size"), F.sha1(html.cast("binary")).alias("sha1"))
    shared = named.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    shared = frozen(shared, "payloads")
    revisits = (F.col("size") >= least_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    typed = joined(named, shared, ["sha1"], "n", pages.count(), "left").select("page_id", "url", "html", "size", F.when(revisits, F.col("first")).alias("refers_to"), F.when(revisits, "revisit").otherwise("response").alias("kind"))
    typed.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").text(path)
    discard(shared)
    system, at = hadoop(pages.sparkSession, path)
    for file in system.listStatus(at):
        name = file.getPath().getName()
        if name.endswith(".txt"):
            system.rename(file.getPath(), at.suffix(f"/{name.removesuffix('.txt')}.warc.gz"))


def _open(path: str) -> io.IOBase:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return open(unquote(url.path) if url.scheme else path, "rb")  # noqa: SIM115
    import pyarrow.fs

    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _member(file: io.IOBase, held: bytes) -> tuple[bytes | None, int, str | None, bytes]:
    """The gzip member at the beginning of `held`, which the file goes on: its data, its length, what is wrong with it, and what is read beyond it.

    No data where no WARC record starts; then, and where something is wrong, nothing of what is read counts as gone.
    """
    gz, out, read = zlib.decompressobj(31), bytearray(), [held]
    while True:
        try:
            out += gz.decompress(read[-1], 0 if out else 16)  # the head first, so that it is known if what follows is damaged
            out += gz.decompress(gz.unconsumed_tail) if gz.unconsumed_tail else b""
        except zlib.error as e:
            return (bytes(out) if out.startswith(b"WARC/") else None), sum(map(len, read)), str(e), b"".join(read)
        if len(out) >= 5 and not out.startswith(b"WARC/"):
            return None, 0, None, b"".join(read)
        if gz.eof:
            return (bytes(out) if out.startswith(b"WARC/") else None), sum(map(len, read)) - len(gz.unused_data), None, gz.unused_data if out.startswith(b"WARC/") else b"".join(read)
        more = file.read(READ_BYTES)
        if not more:
            return (bytes(out) or None), sum(map(len, read)), "truncated", b"".join(read)
        read.append(more)


def range_records(file: io.IOBase, start: int, end: int) -> Iterator[tuple[int, int, bytes, str | None]]:
    """Place, length, data and fault of every record that starts at start or later and before end."""
    file.seek(start)
    at, held = start, b""  # the place of held[0]; the file stands behind held
    while at < end:
        k = held.find(GZIP_MAGIC)
        if k < 0:
            tail = held[max(0, len(held) - len(GZIP_MAGIC) + 1) :]
            at += len(held) - len(tail)
            more = file.read(READ_BYTES)
            if not more:
                return
            held = tail + more
            continue
        at, held = at + k, held[k:]
        if at >= end:
            return
        data, length, fault, held = _member(file, held)
        if data is not None:
            yield at, length, data, fault
        if data is None or fault:
            length, held = 1, held[1:]  # look on right behind this magic
        at += length


def plain_records(file: io.IOBase, start: int, end: int) -> Iterator[tuple[int, int, bytes, str | None]]:
    """As range_records, of a file that isn't compressed: a record begins the file or stands behind an empty line, and ends where its head says."""
    at = max(0, start - len(GAP))
    file.seek(at)
    held = b""

    def more(n: int) -> bool:
        nonlocal held
        while len(held) < n:
            read = file.read(max(READ_BYTES, n - len(held)))
            if not read:
                return False
            held += read
        return True

    while True:
        k = held.find(PLAIN_MARK)
        if k < 0:
            keep = max(0, len(held) - len(GAP) - len(PLAIN_MARK))
            at, held = at + keep, held[keep:]
            if at >= end or not more(len(held) + 1):
                return
            continue
        place = at + k
        if place >= end:
            return
        step = k + 1 - min(k, len(GAP))
        if place >= start and (place == 0 or held[max(0, k - len(GAP)) : k] == GAP):
            head = held.find(GAP, k)
            while head < 0 and len(held) - k < MOST_HEAD and more(len(held) + 1):
                head = held.find(GAP, k)
            n = stated_length(held[k:head]) if head >= 0 else None
            if n is None:
                yield place, len(PLAIN_MARK), held[k : max(head, k)] + GAP, None
            else:
                whole = more(head + len(GAP) + n + len(GAP))
                length = head + len(GAP) + n + len(GAP) - k
                yield place, length, held[k : k + length], None if whole else "truncated"
                if whole:
                    step = k + length - len(GAP)
        at, held = at + step, held[step:]


def head_fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def stated_length(head: bytes) -> int | None:
    """Content-Length of a record's head; None where it is missing or no number of 0 or more."""
    stated = head_fields(head).get("content-length", "")
    return int(stated) if stated.isascii() and stated.isdigit() else None


def parse(data: bytes) -> list[dict]:
    """The records of one member, with what is wrong with each in `fault`; after a length that can't be right, none is looked for.

    Of HTTP responses the payload is what stands behind the HTTP head, and its bytes are counted; a revisit's are those that its HTTP head states.
    """
    out: list[dict] = []
    at = 0
    plain = lambda v: v.strip("<>") if v else None
    while True:
        end = data.find(GAP, at)
        if end < 0:
            return [*out, {"nth": len(out), "fault": "head"}]
        fields, n = head_fields(data[at:end]), stated_length(data[at:end])
        row = {"nth": len(out), "warc_type": fields.get("warc-type"), "record_id": plain(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"), "refers_to": plain(fields.get("warc-refers-to")), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None}
        begin = end + len(GAP)
        if n is None or data[begin + n : begin + n + len(GAP)] != GAP:
            return [*out, row | {"fault": "length"}]
        block = data[begin : begin + n]
        http, _, payload = block.partition(GAP) if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
        stated = [v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"]
        size = int(stated[0]) if stated and stated[0].isdigit() else None
        fault = None
        if row["warc_type"] == "response":
            if stated and size != len(payload):
                fault = "http length"
            elif row["payload_digest"] not in (None, base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                fault = "digest"
        out.append(row | {"payload": payload, "payload_bytes": size if row["warc_type"] == "revisit" and size is not None else len(payload), "fault": fault})
        at = begin + n + len(GAP)
        if not data.startswith(b"WARC/", at):
            return out if not data[at:].strip(b"\0") else [*out, {"nth": len(out), "fault": "trailing bytes"}]


FIELDS = "nth int, warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
ROW = pa.schema([("path", pa.string()), ("span", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("nth", pa.int32()), *[(n, pa.string()) for n in ("warc_type", "record_id", "target_uri", "refers_to", "payload_digest")], ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("fault", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, span, start, end in zip(*[batch.column(n).to_pylist() for n in ("path", "span", "start", "end")], strict=True):
            with _open(path) as file:
                rows, held = [], 0
                records = plain_records if file.read(len(PLAIN_MARK)) == PLAIN_MARK else range_records
                for at, length, data, fault in records(file, start, end):
                    found = [{"nth": 0, "fault": fault}] if fault else parse(data)
                    rows += [{"path": path, "span": span, "offset": at, "length": length, **row} for row in found]
                    held += len(data)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, ROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ROW)


def read_warc(spark: SparkSession, path: str, split_bytes: int = 32 << 20, payload: bool = True) -> DataFrame:
    """A row for each record of the WARC files under path, gzipped or plain, in splits of split_bytes; without `payload`, all but that column.

    A member may hold several records, numbered by nth. Damaged members, heads that can't be read, lengths that aren't those of what
    stands there and wrong digests give a row with `fault` set, and reading goes on behind them. What looks like a record inside another one, as of an
    archive stored in a payload, is none, wherever a split begins: a span's records begin where those of the spans before it end, or later.
    Files without records and empty folders give no rows; records that are in the files twice give two.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    spans = files.select("path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {split_bytes})")).alias("span"))
    ranges = spans.select("path", "span", (F.col("span") * split_bytes).alias("start"), F.least((F.col("span") + 1) * split_bytes, "length").alias("end"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = files.agg(F.sum("length")).first()[0] or 0
    read = ranges.repartition(max(tasks, -(-total // split_bytes)), "path", "start").mapInArrow(_read, f"path string, span long, offset long, length long, {FIELDS}, fault string")
    records = frozen(read if payload else read.drop("payload"), "warc-records")
    # A record's length is known only where it isn't damaged.
    ends = records.groupBy("path", "span").agg(F.max(F.when(F.col("fault").isNull(), F.col("offset") + F.col("length"))).alias("end"))
    before = F.max("end").over(Window.partitionBy("path").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    inner = records.select("path", "span", "offset").join(ends.select("path", "span", before.alias("from")), ["path", "span"]).where(F.col("offset") < F.col("from"))
    return records.join(inner.select("path", "offset").distinct(), ["path", "offset"], "left_anti").drop("span") if inner.limit(1).count() else records.drop("span")

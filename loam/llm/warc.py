"""WARC archives: one gzip member a record, and a reader that salvages damaged archives."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import new_path, partitions, ship, staged, unstage

VERSION, MAGIC = b"WARC/", b"\x1f\x8b\x08"
CHUNK = 1 << 20
BLANK = b"\r\n\r\n"
#: A new archive begins when one has so many bytes; equal payloads from so many bytes on are written once.
ROLL, LEAST = 16 << 20, 100


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record(kind: str, record_id: str, url: str, payload: bytes | None, *, payload_digest: str, payload_bytes: int, page_id: int | None, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """A WARC/1.1 record, compressed to one gzip member. A revisit has the HTTP head only."""
    length = payload_bytes if payload is None else len(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + (payload or b"")
    clean = lambda x: "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in x)  # noqa: E731  no line ends in a header
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:loam:{record_id}>", "WARC-Target-URI": clean(url), "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/http;msgtype=response"}
    head |= {"WARC-Block-Digest": f"sha256:{digest(block)}", "WARC-Payload-Digest": f"sha256:{payload_digest}", "X-Payload-Bytes": str(payload_bytes)}
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": clean(refers_url or "")}
        if refers_to is not None:
            head["X-Refers-To-Page-Id"] = str(refers_to)
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": str(len(block))}).items())
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    offset: int
    end: int
    headers: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head."""
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.block


@dataclass
class Gap:
    """Bytes that no valid record covers, and why the first try at them failed."""

    offset: int
    end: int
    reason: str


class Window:
    """Random reads over a file in chunks: never more than what is asked for, and a chunk, is held."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""
        self.blank = (0, 0)  # from where to where no blank line begins

    def get(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        if not self.at <= offset <= offset + n <= self.at + len(self.data):
            self.file.seek(offset)
            self.at, self.data = offset, self.file.read(max(n, min(CHUNK, self.size - offset)))
        return self.data[offset - self.at : offset - self.at + n]

    def find(self, start: int) -> int:
        """The next place from start on where a member or a version line may begin; size if none."""
        while start < self.size:
            part = self.get(start, CHUNK)
            found = [i for i in (part.find(MAGIC), part.find(VERSION)) if i >= 0]
            if found:
                return start + min(found)
            start += max(1, len(part) - len(VERSION) + 1)
        return self.size


    def head_end(self, start: int) -> int:
        """Where the first blank line from start on begins, however far it is; -1 if none. What was searched once is not searched
        again, so many false starts before one blank line cost one pass."""
        since, upto = self.blank
        at = upto if since <= start <= upto else start
        since = min(since, start) if at == upto else start
        while at < self.size:
            part = self.get(at, CHUNK)
            i = part.find(BLANK)
            if i >= 0:
                self.blank = (since, at + i)
                return at + i
            at += max(1, len(part) - len(BLANK) + 1)
        self.blank = (since, self.size)
        return -1


class Bad(ValueError):
    pass


def parse(get, stop: int, size: int) -> tuple[dict[str, str], int, int]:
    """Headers, and the block's first byte and length, of the record that begins at byte 0 of get(offset, n) and whose headers
    end at byte stop (-1: nowhere); they may be of any length."""
    if stop < 0:
        raise Bad("no end of the headers")
    head = get(0, stop)
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise Bad("no version line")
    headers = {k.strip().lower(): v.strip() for k, c, v in (x.partition(":") for x in lines) if c}
    if not (length := headers.get("content-length", "")).isdigit():
        raise Bad("no valid Content-Length")
    if len(head) + 4 + int(length) + 4 > size:
        raise Bad("it ends too early")
    return headers, len(head) + 4, int(length)


def checked(headers: dict[str, str], block: bytes, tail: bytes) -> None:
    if tail != b"\r\n\r\n":
        raise Bad("no end mark after the block")
    kind, _, value = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and value != digest(block):
        raise Bad("the block's digest differs")


def one(w: Window, at: int) -> Record:
    """The record at a byte; Bad if none or a damaged one is there."""
    if w.get(at, 3) == MAGIC:
        z, parts, pos = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                if not (part := w.get(pos, CHUNK)):
                    raise Bad("the member ends too early")
                parts.append(z.decompress(part))
                pos += len(part)
        except zlib.error as e:
            raise Bad(f"gzip: {e}") from None
        data, end = b"".join(parts), pos - len(z.unused_data)
        headers, start, length = parse(lambda o, n: data[o : o + n], data.find(BLANK), len(data))
        if start + length + 4 != len(data):
            raise Bad("the member holds more than a record")
        block, tail = data[start : start + length], data[start + length :]
    else:
        stop = w.head_end(at) if w.get(at, len(VERSION)) == VERSION else -1
        headers, start, length = parse(lambda o, n: w.get(at + o, n), stop - at if stop >= 0 else -1, w.size - at)
        block, tail, end = w.get(at + start, length), w.get(at + start + length, 4), at + start + length + 4
    checked(headers, block, tail)
    return Record(at, end, headers, block)


def salvage(file, size: int) -> Iterator[Record | Gap]:
    """Records of an archive in order, compressed a member each, plain, or both. After a failed check the reader
    searches the next byte at which a valid record begins; the bytes between come as a Gap. An empty archive gives
    nothing. Holds one record and one chunk at a time."""
    w, at, gap = Window(file, size), 0, None
    while at < size:
        try:
            found = one(w, at)
        except Bad as e:
            gap = gap or Gap(at, at, str(e))
            at = w.find(at + 1)
            continue
        if gap:
            gap.end = at
            yield gap
            gap = None
        yield found
        at = found.end
    if gap:
        gap.end = size
        yield gap


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll: int = ROLL) -> DataFrame:
    """Writes a record for each row of pages, payload the html in UTF-8 (null: empty). Of records with equal payloads
    of at least 100 bytes the one with the smallest id is a response (null ids come last; rows that repeat the smallest id are
    all responses), the others revisit it; smaller ones are all responses.

    Archives go to folder (default: the shared one) through its own file system; a task begins a new one each 16 MB.
    Returns the manifest (path, records, bytes) as a staged table: archives of tasks that were lost or ran twice are
    not in it. Empty table: no archives.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or new_path(spark, "warc")
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url"))
    groups = rows.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), first.alias("f"))
    groups = staged(groups.where("n > 1").select("payload_digest", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"), F.lit(True).alias("shared")), "warc-groups")
    rows = rows.join(groups, "payload_digest", "left").withColumn("revisit", F.coalesce(F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False)))
    out = rows.select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "payload_digest", "payload_bytes", "revisit", "first_id", "first_url")

    def write(batches):
        import pyarrow as pa

        files, at = opened(folder)
        files.create_dir(at, recursive=True)
        sink, done, n, size = None, [], 0, 0

        def close():
            nonlocal sink, n, size
            if sink:
                sink.close()
                done.append((f"{folder}/{name}", n, size))
            sink, n, size = None, 0, 0

        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for x in part.to_pylist():
                    if sink is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        sink = files.open_output_stream(f"{at}/{name}", compression=None)
                    kind = "revisit" if x["revisit"] else "response"
                    link = {"refers_to": x["first_id"], "refers_url": x["first_url"]} if x["revisit"] else {}
                    payload = None if x["revisit"] else x["html"].encode()
                    data = record(kind, uuid.uuid4().hex, x["url"], payload, payload_digest=x["payload_digest"], payload_bytes=x["payload_bytes"], page_id=x["page_id"], **link)
                    sink.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= roll:
                        close()
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), x, strict=True)) for x in done], schema=pa.schema([("path", "string"), ("records", "int64"), ("bytes", "int64")]))

    manifest = staged(out.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")
    unstage(groups)
    return manifest


def read_archives(paths: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records and gaps of the archives in column path: path, offset, end, reason (null for records; for a gap why its
    bytes are quarantined), page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (on demand).
    Digest and length are of the payload itself; of a revisit, which has none, those that its headers claim. An
    archive is one task's work, a record at a time."""
    ship(paths.sparkSession)
    schema = "path string, offset long, `end` long, reason string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload

    def read(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        fields = pa.schema([(n.strip("`"), kinds[k]) for n, k in (x.split() for x in schema.split(", "))])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = opened(path)
                rows, held = [], 0
                with files.open_input_file(at) as f:
                    for x in salvage(f, f.size()):
                        row = {"path": path, "offset": x.offset, "end": x.end}
                        if isinstance(x, Gap):
                            row["reason"] = x.reason
                        else:
                            h, kind = x.headers, x.headers.get("warc-type", "")
                            whole = (int(h.get("x-payload-bytes", 0)), h.get("warc-payload-digest", "").removeprefix("sha256:")) if kind == "revisit" else (len(x.payload), digest(x.payload))
                            row |= {"page_id": int(h["x-page-id"]) if "x-page-id" in h else None, "url": h.get("warc-target-uri"), "record_type": kind, "payload_bytes": whole[0], "payload_digest": whole[1]}
                            row |= {"refers_to": int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None}
                            if with_payload:
                                row["payload"] = x.payload
                                held += len(x.payload)
                        rows.append(row)
                        if len(rows) >= 4096 or held > ROLL:
                            yield pa.RecordBatch.from_pylist(rows, schema=fields)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return paths.select("path").repartition(4 * partitions(paths.sparkSession), "path").mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives and reads these back: a row for each page (page_id, payload_bytes, payload_digest,
    record_type, refers_to)."""
    found = read_archives(write_pages(pages))
    return found.where("reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

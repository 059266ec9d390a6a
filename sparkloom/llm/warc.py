"""WARC archives with a two-level capture index."""

from __future__ import annotations

import bisect
import gzip
import hashlib
import itertools
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, small_side, stored

BLOCK_ENTRIES = 256
LEAST_REVISIT_BYTES = 100
#: Look-ups that one task does, and the most tasks that a stage is cut into.
LOOKUPS, MOST_TASKS = 1000, 50_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"


def url_key(url: str) -> str:
    """The URL with its host reversed: http://www.a.org/x?y gives org,a,www)/x?y. Anything without a host stays."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    tail = url.split("//", 1)[1]
    cut = min((tail.find(c) for c in "/?#" if c in tail), default=len(tail))
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail[cut:]


def _place(folder: str) -> tuple[pa.fs.FileSystem, str]:
    uri = folder if "://" in folder or folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    return pa.fs.FileSystem.from_uri(uri)


def _write(folder: str, name: str, parts: Iterator[bytes]) -> None:
    """Write under a name of this attempt, then move; a repeated task leaves the same file."""
    fs, path = _place(folder)
    task = TaskContext.get()
    tmp = f"{path}/_{name}.{task.taskAttemptId() if task else 0}"
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(tmp, compression=None) as out:
        for part in parts:
            out.write(part)
    fs.move(tmp, f"{path}/{name}")


def _header(value: str) -> str:
    """A header value on one line: blanks and control characters percent-encoded."""
    return quote(value, safe="".join(chr(c) for c in range(33, 127) if chr(c) != "%") + "%")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One record as a gzip member of its own."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_header(url or '')}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = _HTTP
    if refers_to is None:
        block += payload
    else:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            f"WARC-Refers-To-Target-URI: {_header(refers_url or '')}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one decompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    return headers, block.partition(b"\r\n\r\n")[2]


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    pending, inflate, out = b"", None, []
    while True:
        if not pending:
            pending = stream.read(size)
            if not pending:
                break
        if inflate is None:
            inflate, out = zlib.decompressobj(31), []
        out.append(inflate.decompress(pending))
        pending = b""
        if inflate.eof:
            pending = inflate.unused_data
            yield b"".join(out)
            inflate = None
    if inflate is not None:
        raise ValueError("archive is cut short")


def _page(uri: str) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Write one record for each row of pages (page_id, url, html) below folder and return the index entries.

    Null html is an empty payload, a null url an empty one. Of rows with equal payloads of at least least_bytes, those
    with the smallest page_id become responses and the others, also those without a page_id, revisits that name it;
    where no row of a group has a page_id all are responses. Repeated rows are written as often as they come.

    Each task writes archive-N.warc.gz in the order of its rows, so pages are not shuffled to be written; the
    payloads' digests alone are, and the repeated ones among them are joined back, broadcast if proved few. Files
    are written through a file system that folder's scheme names, and moved into place when whole.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    repeated = stored(
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.count("*").alias("rows"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
        .where("rows > 1 and first is not null")
        .select("digest", "first")
    )
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first"))
    marked = rows.join(small_side(repeated), "digest", "left").withColumn("to", first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"archive-{TaskContext.get().partitionId():07d}.warc.gz"
        entries: list[tuple] = []

        def parts() -> Iterator[bytes]:
            at = 0
            for batch in batches:
                for page, url, payload, digest, to, to_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    data = record(page, url, payload, digest, to, to_url)
                    entries.append((url_key(_header(url or "")), "" if page is None else f"{page}", name, at, len(data)))
                    at += len(data)
                    yield data

        first = next(it := parts(), None)
        if first is not None:
            _write(folder, name, itertools.chain([first], it))
            cols = list(zip(*entries, strict=True))
            yield pa.record_batch([pa.array(c) for c in cols], names=["key", "page", "file", "offset", "length"])

    wanted = marked.select("page_id", "url", "payload", "digest", F.expr("if(to is null, null, to.page_id)").alias("to"), F.expr("if(to is null, null, to.url)").alias("to_url"))
    return stored(map_batches(wanted, run, "key string, page string, file string, offset long, length long"))


def write_index(entries: DataFrame, folder: str, block_entries: int = BLOCK_ENTRIES) -> None:
    """Sort the entries into index-N.cdx.gz, blocks of block_entries lines, each with its directory index-N.dir.

    Entries are sorted over range partitions by URL key and page. index.top lists the files with their first keys, in
    order, as many as there are partitions; a last small task writes it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"index-{TaskContext.get().partitionId():07d}"
        lines = ("\t".join(map(str, x)) for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        directory: list[str] = []

        def parts() -> Iterator[bytes]:
            at = 0
            while block := list(itertools.islice(lines, block_entries)):
                data = gzip.compress("\n".join(block).encode(), 6, mtime=0)
                directory.append("\t".join([*block[0].split("\t")[:2], str(at), str(len(data))]))
                at += len(data)
                yield data

        first = next(it := parts(), None)
        if first is not None:
            _write(folder, f"{name}.cdx.gz", itertools.chain([first], it))
            _write(folder, f"{name}.dir", iter(["\n".join(directory).encode()]))
            key, page = directory[0].split("\t")[:2]
            yield pa.record_batch([pa.array([key]), pa.array([page]), pa.array([name])], names=["key", "page", "name"])

    def list_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ["\t".join(x) for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        _write(folder, "index.top", iter(["\n".join(lines).encode()]))
        yield pa.record_batch([pa.array([len(lines)])], names=["files"])

    ordered = entries.select("key", "page", "file", "offset", "length").repartitionByRange("key", "page").sortWithinPartitions("key", "page")
    files = stored(map_batches(ordered, run, "key string, page string, name string"))
    stored(map_batches(files.coalesce(1).sortWithinPartitions("key", "page"), list_files, "files long"))


class CaptureIndex:
    """Finds captures: by binary search among the files, then in a file's directory, then in a block."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = _place(folder)
        self.top = [(k.encode(), p.encode(), n) for k, p, n in self._lines("index.top")]
        self.name, self.directory, self.at, self.block = None, [], None, []

    def _lines(self, name: str) -> list[list[str]]:
        with self.fs.open_input_stream(f"{self.path}/{name}", compression=None) as f:
            return [x.split("\t") for x in f.read().decode().split("\n") if x]

    def _read(self, name: str, offset: int, length: int) -> bytes:
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            return f.read_at(length, offset)

    def entry(self, key: str, page: str) -> list[str] | None:
        """The index line of a capture, or None."""
        want = (key.encode(), page.encode())
        i = bisect.bisect_right(self.top, want, key=lambda x: x[:2]) - 1
        if i < 0:
            return None
        name = self.top[i][2]
        if name != self.name:
            self.name, self.directory, self.at = name, [(x[0].encode(), x[1].encode(), int(x[2]), int(x[3])) for x in self._lines(f"{name}.dir")], None
        j = bisect.bisect_right(self.directory, want, key=lambda x: x[:2]) - 1
        if j < 0:
            return None
        if self.at != j:
            data = gzip.decompress(self._read(f"{name}.cdx.gz", *self.directory[j][2:]))
            self.at, self.block = j, [x.split("\t") for x in data.decode().split("\n")]
        k = bisect.bisect_left(self.block, want, key=lambda x: (x[0].encode(), x[1].encode()))
        return self.block[k] if k < len(self.block) and self.block[k][:2] == [key, page] else None

    def payload(self, key: str, page: str) -> bytes:
        """The payload of a capture, by a range read of its record."""
        entry = self.entry(key, page)
        if entry is None:
            raise KeyError(f"no capture of {key} with page {page}")
        return parse(gzip.decompress(self._read(entry[2], int(entry[3]), int(entry[4]))))[1]


def _tasks(df: DataFrame, each: int) -> int:
    """So many tasks that each has about so many rows, up to MOST_TASKS."""
    return max(1, min(MOST_TASKS, -(-df.count() // each)))


def read_archives(folder: str, files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record of the archives.

    files lists the archives (column file). Archives are read front to back, one record at a time and one task for
    each archive, and a response's size and digest are taken from its payload. The payload of a revisit is that of the
    response it names: each response named is looked up once in the capture index and range-read, by tasks of
    neighbouring keys. No archives give no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _place(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for data in members(f):
                        headers, payload = parse(data)
                        page, revisit = _page(headers["WARC-Record-ID"]), headers["WARC-Type"] == "revisit"
                        if revisit:
                            rows.append((page, None, None, "revisit", _page(headers["WARC-Refers-To"]), url_key(headers["WARC-Refers-To-Target-URI"])))
                        else:
                            digest = hashlib.sha256(payload).hexdigest()
                            if headers["WARC-Payload-Digest"] != f"sha256:{digest}":
                                raise ValueError(f"the payload of page {page} is damaged")
                            rows.append((page, len(payload), digest, "response", None, None))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    cols = zip(*rows, strict=True)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_key"])

    names = files.select("file").distinct()
    records = stored(map_batches(names.repartitionByRange(_tasks(names, 1), "file"), read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_key string"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder)
        for batch in batches:
            sizes, digests = [], []
            for page, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = index.payload(key, str(page))
                sizes.append(len(payload))
                digests.append(hashlib.sha256(payload).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["refers_to", "payload_bytes", "payload_digest"])

    revisits = records.where("record_type = 'revisit'")
    named = stored(revisits.groupBy("refers_to").agg(F.min("refers_key").alias("refers_key")))
    ordered = named.repartitionByRange(_tasks(named, LOOKUPS), "refers_key", "refers_to").sortWithinPartitions("refers_key", "refers_to")
    found = stored(map_batches(ordered, look_up, "refers_to long, payload_bytes long, payload_digest string"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").select(columns).unionAll(revisits.drop("payload_bytes", "payload_digest").join(found, "refers_to").select(columns))

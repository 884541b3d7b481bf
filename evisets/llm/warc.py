"""WARC archives with revisit records, and a two-level capture index over them.

Writing: of equal payloads only the first capture is stored, the others are revisit records that name it. Each task writes archives of its own and
returns where each record lies; that manifest is stored at once, so a repeated task leaves at worst files that nothing refers to.

Index: entries ``reversed-host URL key, capture`` are sorted over all tasks. Each task writes its range as compressed blocks of lines plus a sparse
directory with each block's first entry, offset and length. A lookup searches the list of ranges, then the range's directory, then the block's
lines by bisection, reads only that block, and reads the record itself by its range in the archive.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisets.llm.common import shared_folder, shuffle_width, stored

LEAST = 100  # bytes from which equal payloads are stored once
BLOCK = 1000  # index lines in a block
ROLL = 1 << 30  # bytes after which a task begins another archive
DATE = "2024-01-01T00:00:00Z"
NO_URL = "urn:x-none"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url: str | None) -> str:
    """Host labels in reverse order, comma between, then ')' and path and query; scheme, user, port and fragment are left out."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").rstrip(".")
        rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        host, rest = "", url
    return quote(",".join(reversed(host.split("."))) + ")" + rest, safe="!#$%&'()*+,/:;=?@[]~|^{}`\"<>\\")


def entry(url: str | None, capture) -> str:
    """What the index is sorted by; a key has no blank, so entries sort by key, then capture."""
    return f"{url_key(url)} {'-' if capture is None else f'{capture:020d}' if isinstance(capture, int) else capture}"


def record_id(capture) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(str(capture).encode()).digest()[:16])}>"


def record(capture, url, payload: bytes, digest: str, first, first_url) -> bytes:
    """One compressed record: a response, or a revisit of ``first`` if that is given."""
    revisit = first is not None
    body = HEAD + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(capture)), ("WARC-Date", DATE), ("WARC-Target-URI", url or NO_URL),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("Capture", json.dumps(capture)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first)),
                 ("WARC-Refers-To-Target-URI", first_url or NO_URL), ("WARC-Refers-To-Date", DATE), ("Refers-To-Capture", json.dumps(first))]
    text = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n" for k, v in head)
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(b"WARC/1.1\r\n" + text.encode("utf-8", "surrogatepass") + b"\r\n" + body + b"\r\n\r\n") + gz.flush()


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and payload of a compressed record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this place")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@functools.lru_cache(16)
def opened(path: str):
    where, name = at(path)
    return where.open_input_file(name)


def new_folder(spark, name: str) -> str:
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where, path = at(folder)
    where.create_dir(path, recursive=True)
    return folder


def write(pages: DataFrame, folder: str, capture: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """Write every row of ``pages`` as a record under ``folder``; the manifest: entry, capture, file, offset, length.

    A null payload is empty. Payloads below ``least`` bytes are always stored; of equal larger ones that of the smallest capture is, repeated
    rows of that capture included. A null capture is stored if its payload has no other capture.
    """
    src = pages.select(F.col(capture).alias("capture"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumn("digest", F.sha2("payload", 256))
    first = src.where(F.octet_length("payload") >= least).groupBy("digest").agg(
        F.min("capture").alias("first"), F.min_by("url", "capture").alias("first_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    src = src.join(first, "digest", "left").select("capture", "url", "payload", "digest", F.expr("nullif(first, capture)").alias("first"), "first_url")

    def rows(batches):
        sink, size, path = None, 0, ""
        for b in batches:
            out = []
            for x in b.to_pylist():
                if sink is None or size >= ROLL:
                    if sink is not None:
                        sink.close()
                    path, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    where, name = at(path)
                    sink = where.open_output_stream(name, compression=None)
                raw = record(x["capture"], x["url"], x["payload"], x["digest"], x["first"], x["first_url"])
                sink.write(raw)
                out.append((entry(x["url"], x["capture"]), path, size, len(raw)))
                size += len(raw)
            e, p, o, n = zip(*out) if out else ((),) * 4
            yield pa.record_batch([pa.array(e, pa.string()), b.column(0), pa.array(p, pa.string()), pa.array(o, pa.int64()), pa.array(n, pa.int64())],
                                  ["entry", "capture", "file", "offset", "length"])
        if sink is not None:
            sink.close()

    kind = src.schema["capture"].dataType.simpleString()
    return stored(src.mapInArrow(rows, f"entry string, capture {kind}, file string, offset bigint, length bigint"), "warc-manifest")


def index(manifest: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Write the sorted blocks and their directories; the list of ranges: first, last, blocks, directory. It has a row per task."""
    spark = manifest.sparkSession

    def rows(batches):
        where, path = at(f"{folder}/{uuid.uuid4().hex}")
        first = last = None
        directory, lines, place = [], [], 0
        with where.open_output_stream(f"{path}.cdx", compression=None) as sink:
            def flush():
                nonlocal place
                raw = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))
                sink.write(raw)
                directory.append(json.dumps([lines[0].split("\t", 1)[0], place, len(raw)]))
                place += len(raw)
                lines.clear()

            for b in batches:
                for e, f, o, n in zip(*(b.column(c).to_pylist() for c in ("entry", "file", "offset", "length")), strict=True):
                    first, last = first or e, e
                    lines.append(f"{e}\t{f}\t{o}\t{n}")
                    if len(lines) >= block:
                        flush()
            if lines:
                flush()
        if first is not None:
            with where.open_output_stream(f"{path}.dir", compression=None) as sink:
                sink.write("\n".join(directory).encode())
            name = f"{folder}/{path.rsplit('/', 1)[1]}"
            yield pa.record_batch([pa.array([x], pa.string()) for x in (first, last, f"{name}.cdx", f"{name}.dir")], ["first", "last", "blocks", "directory"])

    ordered = manifest.repartitionByRange(shuffle_width(spark), "entry").sortWithinPartitions("entry").select("entry", "file", "offset", "length")
    return stored(ordered.mapInArrow(rows, "first string, last string, blocks string, directory string"), "warc-ranges")


class Index:
    """Lookups in the files that ``index`` wrote. Directories and the last blocks are kept."""

    def __init__(self, ranges: list[tuple[str, str, str, str]]):
        self.ranges = sorted(ranges)
        self.lasts = [r[1] for r in self.ranges]
        self.directory, self.block = functools.lru_cache(8)(self.read_directory), functools.lru_cache(4)(self.read_block)

    def read_directory(self, path: str) -> list[list]:
        where, name = at(path)
        with where.open_input_file(name) as f:
            return [json.loads(x) for x in f.read().decode().split("\n")]

    def read_block(self, path: str, place: int, size: int) -> list[list[str]]:
        return [x.split("\t") for x in zlib.decompress(opened(path).read_at(size, place)).decode("utf-8", "surrogatepass").split("\n")]

    def find(self, want: str):
        """(file, offset, length) of each capture with this entry; equal entries may reach over blocks and ranges."""
        for _, last, blocks, directory in self.ranges[bisect.bisect_left(self.lasts, want) :]:
            listed = self.directory(directory)
            i = max(0, bisect.bisect_left(listed, want, key=lambda d: d[0]) - 1)
            while i < len(listed) and listed[i][0] <= want:
                lines = self.block(blocks, *listed[i][1:])
                j = bisect.bisect_left(lines, want, key=lambda x: x[0])
                while j < len(lines) and lines[j][0] == want:
                    yield lines[j][1], int(lines[j][2]), int(lines[j][3])
                    j += 1
                i += 1
            if last > want:
                return


def lookup(wanted: DataFrame, ranges: DataFrame, capture: str = "page_id", url: str = "url") -> DataFrame:
    """Records of the captures in ``wanted``, read back: capture, url, record_type, payload_digest, payload_bytes, payload, refers_to.

    Digest and size are of the payload that was read; a revisit has its recorded digest, no payload and a null size. A wanted pair that repeats
    is looked up once; one that the index doesn't hold gives no row. Wanted entries are sorted, so a task reads each block about once. The list
    of ranges has a row per task of ``index`` and goes to every task.
    """
    src = wanted.select(F.col(capture).alias("capture"), F.col(url).alias("url"))
    kind = src.schema["capture"].dataType.simpleString()
    known = [tuple(r) for r in ranges.select("first", "last", "blocks", "directory").collect()]

    def entries(batches):
        for b in batches:
            yield pa.record_batch([pa.array([entry(u, c) for c, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())], ["entry"])

    def rows(batches):
        search = Index(known)
        for b in batches:
            out = []
            for e in b.column(0).to_pylist():
                for path, offset, length in search.find(e):
                    fields, payload = parsed(opened(path).read_at(length, offset))
                    revisit = fields["WARC-Type"] == "revisit"
                    noted = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    digest = noted if revisit else hashlib.sha256(payload).hexdigest()
                    if digest != noted:
                        raise ValueError(f"the payload at {offset} of {path} doesn't match its digest")
                    target = fields["WARC-Target-URI"]
                    out.append((json.loads(fields["Capture"]), None if target == NO_URL else target, fields["WARC-Type"], digest,
                                None if revisit else len(payload), None if revisit else payload, json.loads(fields.get("Refers-To-Capture", "null"))))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 7, kinds, strict=True)], names)

    id_type = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
    names = ["capture", "url", "record_type", "payload_digest", "payload_bytes", "payload", "refers_to"]
    kinds = [id_type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), id_type]
    shown = "bigint" if id_type == pa.int64() else "string"
    keys = src.mapInArrow(entries, "entry string").distinct()
    keys = keys.repartitionByRange(shuffle_width(wanted.sparkSession), "entry").sortWithinPartitions("entry")
    return keys.mapInArrow(rows, f"capture {shown}, url string, record_type string, payload_digest string, payload_bytes bigint, payload binary, refers_to {shown}")


def archived(pages: DataFrame, capture: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder, index them and read every capture back through the index; a revisit's size is that of the
    record it refers to. One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to. An empty table gives an empty one."""
    folder = new_folder(pages.sparkSession, "warc")
    ranges = index(write(pages, folder, capture, url, payload), folder)
    back = stored(lookup(pages, ranges, capture, url).drop("payload", "url"), "warc-read")
    sizes = back.where("record_type = 'response' and payload_bytes > 0").select(F.col("capture").alias("refers_to"), F.col("payload_bytes").alias("size")).dropDuplicates(["refers_to"])
    back = back.join(sizes, "refers_to", "left")
    return back.select(F.col("capture").alias("page_id"), F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")

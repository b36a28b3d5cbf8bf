"""WARC bundles: independent Zstandard frames, a footer seek table and an index of record places.

A bundle is a file of Zstandard frames. Each frame holds some whole WARC records, so it can be read alone. The last
frame is a skippable one, the seek table of the seekable format: sizes of all frames, then a nine-byte footer. The
index maps each record to its bundle, frame and offset within the frame's content.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Uncompressed bytes after which a frame is closed, and a bundle.
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 64 * 1024 * 1024
#: Payloads below this are never revisits.
MIN_REVISIT_BYTES = 1000
#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = (
    "record_id string, page_id long, record_type string, refers_to long, bundle string, frame long,"
    " frame_offset long, record_bytes long"
)
RECORDS = (
    "page_id long, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string,"
    " url string, bundle string, frame long, frame_offset long"
)


def classify(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html (null: empty), digest (SHA-1) and refers_to of each page.

    Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the largest page_id is the response,
    others refer to it. Repeated rows of that page_id are responses too; a null page_id refers like any other, and a
    group of nulls only has no response to refer to, so all are responses.

    Only digests found twice or more are joined back: one row each, so a hot payload is split like any skewed join.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")
    ).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    large = F.octet_length("html") >= min_bytes
    groups = (
        rows.where(large)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("response_id"))
        .where("copies > 1")
        .drop("copies")
    )
    return rows.join(groups, "digest", "left").select(
        "page_id",
        "url",
        "html",
        "digest",
        F.when(F.col("page_id").eqNullSafe(F.col("response_id")), None).otherwise(F.col("response_id")).alias("refers_to"),
    )


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}"


def _record(page_id, url, html, digest, refers_to) -> tuple[str, bytes]:
    payload = (html or "").encode("utf-8", "surrogatepass")
    rid = record_id(page_id, digest)
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{rid}>",
        "WARC-Page-ID": "" if page_id is None else str(page_id),
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        head["WARC-Refers-To"] = f"<{record_id(refers_to, digest)}>"
        head["WARC-Refers-To-Page-ID"] = str(refers_to)
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        payload = b""
    head["Content-Length"] = str(len(payload))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return rid, b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, size, headers, payload) of each record in the content of a frame."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(head["Content-Length"])
        payload = content[end + 4 : end + 4 + size]
        yield at, end + 4 + size + 4 - at, head, payload
        at = end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle; frames: (compressed, uncompressed) sizes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, uncompressed) of each frame, from the footer."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC or flags != 0:
        raise ValueError("the bundle has no seek table that can be read")
    start = len(bundle) - 9 - 8 * count
    if struct.unpack("<II", bundle[start - 8 : start]) != (SKIPPABLE_MAGIC, 8 * count + 9):
        raise ValueError("the seek table is damaged")
    out, at = [], 0
    for compressed, size in struct.iter_unpack("<II", bundle[start:-9]):
        out.append((at, compressed, size))
        at += compressed
    if at != start - 8:
        raise ValueError("the frames don't fill the bundle")
    return out


class _Bundle:
    """One bundle under construction, as frames in memory; at most BUNDLE_BYTES and one record."""

    def __init__(self):
        self.frames: list[tuple[int, int]] = []
        self.out: list[bytes] = []
        self.open: list[bytes] = []
        self.open_bytes = self.total = 0
        self.index: list[tuple] = []
        self.compressor = zstandard.ZstdCompressor(level=3)

    def add(self, rid, page_id, refers_to, record: bytes, frame_bytes: int) -> None:
        kind = "response" if refers_to is None else "revisit"
        self.index.append((rid, page_id, kind, refers_to, len(self.frames), self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)
        self.total += len(record)
        if self.open_bytes >= frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.compressor.compress(b"".join(self.open))
            self.frames.append((len(frame), self.open_bytes))
            self.out.append(frame)
            self.open, self.open_bytes = [], 0

    def content(self) -> bytes:
        self.close_frame()
        return b"".join(self.out) + seek_table(self.frames)


def write_bundles(
    classified: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> DataFrame:
    """Write bundles into a shared folder as the returned index (see INDEX) is computed."""

    def write(batches):
        bundle, number, task = _Bundle(), 0, TaskContext.get().partitionId()

        def close():
            name = save_bundle(folder, bundle.content(), f"{task:05d}-{number:05d}")
            cols = list(zip(*bundle.index))
            names = ["record_id", "page_id", "record_type", "refers_to", "frame", "frame_offset", "record_bytes"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            data = {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)}
            data["bundle"] = pa.array([name] * len(bundle.index), pa.string())
            order = ["record_id", "page_id", "record_type", "refers_to", "bundle", "frame", "frame_offset", "record_bytes"]
            return pa.RecordBatch.from_pydict({n: data[n] for n in order})

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                rid, record = _record(page_id, url, html, digest, refers_to)
                bundle.add(rid, page_id, refers_to, record, frame_bytes)
                if bundle.total >= bundle_bytes:
                    yield close()
                    bundle, number = _Bundle(), number + 1
        if bundle.index:
            yield close()

    return classified.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, INDEX)


def save_bundle(folder: str, content: bytes, place: str) -> str:
    """Write a bundle, whole or not at all, under a name made of its place (task and number in it) and its content.

    Bundles of equal content in other places are files of their own; a repeated task writes the same file.
    """
    store, path = pafs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    store.create_dir(path, recursive=True)
    name = f"{place}-{hashlib.sha1(content).hexdigest()}.warc.zst"
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, f"{path}/{name}")
    return name


def read_bundles(spark: SparkSession, folder: str, bundles: DataFrame | None = None) -> DataFrame:
    """Read every record of the bundles in a folder back (see RECORDS), frame by frame, digest and length checked.

    With ``bundles`` (column bundle: names from an index) files that no index names, as a lost attempt may leave, are
    passed over. Revisits have the digest and length of the payload that they refer to.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.warc.zst")
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content")
    )
    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                yield from _bundle_rows(name, content)

    records = files.mapInArrow(read, RECORDS)
    return records if bundles is None else records.join(bundles.select("bundle").distinct(), "bundle", "left_semi")


def _bundle_rows(name: str, content: bytes) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for number, (at, size, whole) in enumerate(read_seek_table(content)):
        rows = []
        frame = unpack.decompress(content[at : at + size], max_output_size=whole)
        for offset, _, head, payload in parse_records(frame):
            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
            refers = head.get("WARC-Refers-To-Page-ID")
            n_bytes = int(head["WARC-Payload-Length"])
            if head["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, n_bytes):
                raise ValueError(f"a payload of {name} is damaged")
            page = head["WARC-Page-ID"]
            rows.append(
                (
                    int(page) if page else None,
                    head["WARC-Record-ID"].strip("<>"),
                    head["WARC-Type"],
                    int(refers) if refers else None,
                    n_bytes,
                    digest,
                    head["WARC-Target-URI"],
                    name,
                    number,
                    offset,
                )
            )
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = ["page_id", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "url", "bundle", "frame", "frame_offset"]
        yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)})


def read_record(folder: str, bundle: str, frame: int, frame_offset: int, record_bytes: int) -> tuple[dict[str, str], bytes]:
    """One record through the index: reads the seek table and a single frame, not the bundle."""
    store, path = pafs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    with store.open_input_file(f"{path}/{bundle}") as file:
        size = file.size()
        file.seek(size - 9)
        count = struct.unpack("<IBI", file.read(9))[0]
        file.seek(size - 9 - 8 * count)
        sizes = list(struct.iter_unpack("<II", file.read(8 * count)))
        file.seek(sum(s for s, _ in sizes[:frame]))
        content = zstandard.ZstdDecompressor().decompress(file.read(sizes[frame][0]), max_output_size=sizes[frame][1])
    _, _, head, payload = next(parse_records(content[frame_offset : frame_offset + record_bytes]))
    return head, payload

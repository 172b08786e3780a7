"""WARC archives as per-record Zstandard frames that share a dictionary.

Each archive starts with a skippable frame that holds the archive's own dictionary, trained on a bounded sample of its
first records; then each record is a frame of its own, compressed with that dictionary, so that one record can be read
alone. Records with equal long payloads are written once, as a response; the others are revisits without a payload.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_weight, pinned, removed, shared_dir, shuffle_width

MIN_REVISIT_BYTES = 1000
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20  # of an archive's first records, for the dictionary
SAMPLE_RECORDS = 400
ARCHIVE_BYTES = 256 << 20  # of payload, after which the next archive begins
LEVEL = 6
# Fixed values of the public formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
ESCAPED = "WARC-X-Target-URI-Escaped: yes"


def target_lines(url: str) -> list[str]:
    """Header lines with an address as it is. One with control characters, which can't stand in a header, has these and its percent signs escaped, and says so."""
    if not _CONTROL.search(url):
        return [f"WARC-Target-URI: {url}"]
    return ["WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", url), ESCAPED]


def target_of(fields: dict[str, str]) -> str:
    """The address that target_lines wrote."""
    url, (name, mark) = fields["WARC-Target-URI"], ESCAPED.split(": ")
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url) if fields.get(name) == mark else url


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    block = http_head(len(payload)) + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {NO_DATE}",
        *target_lines(url or ""),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes]):
    """A dictionary of the records' common parts; of too few or too small records, their own first bytes."""
    import zstandard

    sample = [r for r in records if r]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, sample)) // 8)), sample, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes one archive to a binary file object. The first records are held until the dictionary is trained."""

    def __init__(self, out):
        self.out, self.held, self.size, self.compressor = out, [], 0, None

    def add(self, data: bytes) -> None:
        if self.compressor is None:
            self.held.append(data)
            self.size += len(data)
            if self.size >= SAMPLE_BYTES or len(self.held) >= SAMPLE_RECORDS:
                self._begin()
        else:
            self.out.write(self.compressor.compress(data))

    def _begin(self) -> None:
        import zstandard

        trained = train_dictionary(self.held)
        content = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True, write_checksum=True)
        for data in self.held:
            self.out.write(self.compressor.compress(data))
        self.held = []

    def close(self) -> None:
        if self.compressor is None:
            self._begin()


def read_records(source) -> Iterator[bytes]:
    """The records of an archive, one by one, from a binary stream; memory holds one record and a read buffer."""
    import zstandard

    head = source.read(8)
    if not head:
        return
    magic, length = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't start with a dictionary frame")
    content = source.read(length)
    if content[:4] == FRAME:
        content = zstandard.ZstdDecompressor().decompress(content)
    trained = zstandard.ZstdCompressionDict(content)
    decompressor = zstandard.ZstdDecompressor(dict_data=trained)
    rest = b""
    while True:
        frame, parts = decompressor.decompressobj(), []
        data = rest or source.read(1 << 18)
        if not data:
            return
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                rest = frame.unused_data
                break
            data = source.read(1 << 18)
            if not data:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    return fields, rest[: int(fields["Content-Length"])]


def page_of(name: str | None) -> int | None:
    found = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found not in ("", "none") else None


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """pages with digest and refers_to: the largest page_id among pages of equal long payloads, null on that page itself."""
    digests = pinned(pages.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", F.sha1("payload").alias("digest")))
    copies = pinned(digests.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1"))
    keyed = joined_by_weight(digests, copies, "digest", "n")
    return keyed.where(F.col("page_id") != F.col("last")).select("page_id", "digest", F.col("last").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write each row as a record, in one archive or more for each task; (path, records, bytes) of the archives.

    A task writes to a name of its own and renames it when it is whole, so that a task that runs again, after its
    executor was lost, leaves the same archive. A null html is an empty payload; a null id never takes part in
    revisits; repeated ids with equal payloads are all written as the same kind of record.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    revisits = with_revisits(rows, min_bytes)
    keyed = rows.withColumn("digest", F.sha1("payload")).join(revisits, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        writer = out = None
        name = temporary = ""
        made = count = written = 0
        done: list[tuple[str, int, int]] = []

        def finish() -> None:
            nonlocal writer
            writer.close()
            out.close()
            store.move(temporary, name)
            done.append((name, count, written))
            writer = None

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for row in range(batch.num_rows):
                page, url, payload, digest, refers = (c[row].as_py() for c in columns)
                if writer is None:
                    name = f"{root}/part-{context.partitionId():05d}-{made:03d}.warc.zst"
                    temporary = f"{name}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary, compression=None)
                    writer, made, count, written = ArchiveWriter(out), made + 1, 0, 0
                writer.add(record(page, url, payload, digest, refers))
                count += 1
                written += len(payload)
                if written >= ARCHIVE_BYTES:
                    finish()
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return pinned(keyed.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rows of all records in the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    parts = shuffle_width(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as source:
                    for data in read_records(source):
                        fields, block = parse_record(data)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        rows.append((page_of(fields["WARC-Record-ID"]), target_of(fields), size, digest, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To"))))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    spread = archives.select("path").repartition(parts, F.xxhash64("path"))
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to archives and read them back, one row for each row of pages.

    Archives in the given folder stay; without one they go to the shared folder, and are deleted once they are read.
    What becomes of null html and null or repeated ids is as for write_archives; other columns are ignored.
    """
    if folder:
        return read_archives(write_archives(pages, folder), folder)
    own = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    found = pinned(read_archives(write_archives(pages, own), own))
    removed(pages.sparkSession, own)
    return found


def archive_bytes(records: list[bytes]) -> bytes:
    """A whole archive in memory, for small uses."""
    out = io.BytesIO()
    writer = ArchiveWriter(out)
    for r in records:
        writer.add(r)
    writer.close()
    return out.getvalue()

"""WARC archives: a writer of one gzip member per record, and a salvage reader that survives damage.

The reader checks every member (gzip's own checks) and record (version line, headers, declared length, payload digest).
After a failed check it looks for the next gzip member or version line, goes on from there, and logs the bytes between as
a quarantined gap. It does so inside a member too, on what inflates of it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanework.llm import _base

MEMBER, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/\d+\.\d+\r\n")
FILE_BYTES = 8 << 20
#: A record's headers end within so many bytes.
HEADER_BYTES = 64 << 10
BLANK_LINE, NEXT_VERSION = b"\r\n\r\n", re.compile(rb"\r\nWARC/\d+\.\d+\r\n")
#: A record of fewer payload bytes is stored again rather than referred to.
REVISIT_BYTES = 1000
DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """An uncompressed record. A revisit keeps the digest and length of the payload, not its bytes."""
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", uri)), ("WARC-Payload-Digest", digest(payload)), ("WARC-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        payload = b""
    headers.append(("Content-Length", str(len(payload))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Ahead:
    """The next place of something at or after positions that never fall: the data are searched once, however many ask."""

    def __init__(self, data: bytes, what: bytes | re.Pattern[bytes]):
        self.data, self.what, self.place = data, what, -1

    def after(self, at: int) -> int:
        """The data's length if there is none."""
        if self.place < at:
            if isinstance(self.what, bytes):
                place = self.data.find(self.what, at)
            else:
                found = self.what.search(self.data, at)
                place = found.start() if found else -1
            self.place = len(self.data) if place < 0 else place
        return self.place


def parse_record(data: bytes, at: int, blank: Ahead | None = None) -> tuple[dict[str, str], bytes, int] | str:
    """(headers, payload, end) of the record that starts at ``at``, or what is wrong with it. blank: the data's blank lines, for many rising starts.

    Headers end at the first blank line; they are bounded, and hold no version line.
    """
    version = VERSION.match(data, at)
    if not version:
        return "no version line"
    end = (blank or Ahead(data, BLANK_LINE)).after(version.end() - 2)
    if end - version.end() > HEADER_BYTES or end == len(data):
        return f"headers do not end within {HEADER_BYTES} bytes"
    if NEXT_VERSION.search(data, version.end() - 2, end + 2):
        return "another record begins in the headers"
    headers = {}
    for line in data[version.end() : end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        return "no content length"
    start, stop = end + 4, end + 4 + int(length)
    if stop > len(data):
        return "payload is cut short"
    if data[stop : stop + 4] != BLANK_LINE:
        return "record does not end where it says"
    payload = data[start:stop]
    claimed = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and claimed.startswith("sha1:") and claimed != digest(payload):
        return "payload digest differs"
    return headers, payload, start + len(payload) + 4


def member_begins(data: bytes, at: int) -> bool:
    """Whether the gzip header at ``at`` comes to an end: its name and comment, if any, within 4096 bytes each."""
    if len(data) < at + 10 or data[at + 3] & 0xE0:
        return False
    flags, end = data[at + 3], at + 10
    if flags & 4:
        end += 2 + int.from_bytes(data[end : end + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            end = data.find(b"\0", end, end + 4096) + 1
            if not end:
                return False
    return end + 2 * (flags >> 1 & 1) <= len(data)


def inflate(data: bytes, at: int, step: int = 1 << 14) -> tuple[bytes, int | None, str]:
    """What the member at ``at`` holds, where it ends and ""; or what inflates before it fails, None and the reason."""
    if not member_begins(data, at):
        return b"", None, "member header does not end"
    unpacker, parts = zlib.decompressobj(31), []
    for start in range(at, len(data), step):
        before = unpacker.copy()
        try:
            parts.append(unpacker.decompress(data[start : start + step]))
        except zlib.error as e:
            try:
                for i in range(start, start + step):
                    parts.append(before.decompress(data[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(parts), None, f"member fails: {e}"
        if unpacker.eof:
            return b"".join(parts), min(start + step, len(data)) - len(unpacker.unused_data), ""
    return b"".join(parts), None, "member is cut short"


def inflated_by(data: bytes, at: int, size: int, step: int = 1 << 14) -> int:
    """How far the member at ``at`` must be read for its first ``size`` inflated bytes."""
    unpacker = zlib.decompressobj(31)
    while True:
        before = unpacker.copy()
        try:
            found = len(unpacker.decompress(data[at : at + step]))
        except zlib.error:
            found = size
        if found < size:
            size, at = size - found, at + step
        elif step == 1:
            return at + 1
        else:
            unpacker, step = before, 1


def records_in(plain: bytes) -> tuple[list[tuple[dict[str, str] | None, bytes | None, str | None]], int]:
    """(headers, payload, None) of every record and (None, None, reason) of every gap, in order, and where the last record ends."""
    found, at, last = [], 0, 0
    blank, version = Ahead(plain, BLANK_LINE), Ahead(plain, VERSION)
    while at < len(plain):
        one = parse_record(plain, at, blank)
        if isinstance(one, str):
            if not found or found[-1][0] is not None:
                found.append((None, None, one))
            at = version.after(at + 1)
        else:
            found.append((*one[:2], None))
            at = last = one[2]
    return found, last


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | None, str | None]]:
    """(offset, bytes, headers, payload, None) of every record and (offset, bytes, None, None, reason) of every gap, in order.

    Records and gaps inside a member have the member's offset and bytes; a damaged one reaches to what is sound again. The
    check of a member of one record is that record's own; of more records, each is judged by itself.
    """
    at, n = 0, len(data)
    blank, version, member_start = Ahead(data, BLANK_LINE), Ahead(data, VERSION), Ahead(data, MEMBER)
    bad: tuple[int, str] | None = None
    kept: list = []  # what the damaged member at bad[0] gave before it failed

    def gap(to: int):
        for one in kept:
            yield bad[0], to - bad[0], *one
        if bad:
            yield bad[0], to - bad[0], None, None, bad[1]

    while at < n:
        found: list = []
        end, reason, resume = at, "neither a member nor a version line", at + 1
        if data.startswith(MEMBER, at):
            plain, stop, reason = inflate(data, at)
            found, last = records_in(plain)
            if stop is not None:
                end = resume = stop
                if found and not last:
                    reason, found = found[0][2], []
            else:
                if found and found[-1][0] is None:
                    found.pop()
                alone = len(found) == 1 and b"\r\n\r\n" not in plain[last:] and reason.endswith(("incorrect data check", "incorrect length check"))
                if found and not alone:
                    yield from gap(at)
                    bad, kept = (at, reason), found
                    resume = inflated_by(data, at, last)
                found = []
        elif VERSION.match(data, at):
            one = parse_record(data, at, blank)
            if isinstance(one, str):
                reason = one
            else:
                found, end, reason = [(*one[:2], None)], one[2], ""
        if not reason:
            yield from gap(at)
            bad, kept = None, []
            for one in found:
                yield at, end - at, *one
            at = end
            continue
        bad = bad or (at, reason)
        at = min(member_start.after(resume), version.after(resume))
    yield from gap(n)


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the largest page_id of an equal payload, where that is another page.

    A null html counts as empty. Payloads are compared by SHA-1 and length; only ids and digests are grouped, so one
    payload on a third of all pages costs one row per task. A null page_id is smaller than any; rows that share the
    largest id all stay responses.
    """
    html_or_empty = F.coalesce(pages[html], F.lit(""))
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"), html_or_empty.alias("html"), F.sha1(html_or_empty.cast("binary")).alias("sha1"))
    ids = rows.select("page_id", "sha1", F.octet_length("html").alias("size")).where(F.col("size") >= revisit_bytes)
    ids = _base.save(ids, "payloads")
    keepers = ids.groupBy("sha1", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").drop("n")
    revisits = ids.join(keepers, ["sha1", "size"]).where("not page_id <=> keeper").select(F.col("page_id").alias("again"), F.col("sha1").alias("again_sha1"), F.col("keeper").alias("refers_to")).distinct()
    mine = [F.col("page_id").eqNullSafe(F.col("again")), F.col("sha1") == F.col("again_sha1")]
    return rows.join(revisits, mine, "left").select("page_id", "url", "html", "refers_to")


def write_archives(planned: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write planned pages as .warc.gz files below folder (on a store that all executors see); (file, records, bytes) of each.

    A task fills one file after another. They are named after its partition and moved into place whole, so a task that
    runs again replaces its own.
    """
    import pyarrow as pa

    _base.small_batches(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        files: list[tuple[str, int, int]] = []
        members: list[bytes] = []

        def flush() -> None:
            name = f"part-{context.partitionId():06d}-{len(files):06d}.warc.gz"
            data = b"".join(members)
            own = f"{root}/.{name}.{context.taskAttemptId()}"
            with store.open_output_stream(own, compression=None) as out:
                out.write(data)
            store.move(own, f"{root}/{name}")
            files.append((name, len(members), len(data)))
            members.clear()

        size = 0
        for batch in batches:
            for page, uri, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = "response" if refers_to is None else "revisit"
                members.append(member(record(kind, f"urn:page:{'' if page is None else page}", uri or "", html.encode(), None if refers_to is None else f"urn:page:{refers_to}")))
                size += len(members[-1])
                if size >= file_bytes:
                    flush()
                    size = 0
        if members:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in files], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    return planned.select("page_id", "url", "html", "refers_to").mapInArrow(run, "file string, records long, bytes long")


def read_archives(spark, folder: str, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the archives below folder.

    (file, offset, bytes, record_type, record_id, uri, refers_to, payload, payload_bytes, payload_digest, error): a gap has
    record_type null and its reason in error. Digest (bare lower-case hex) and length are of the full payload: computed
    for stored payloads, as recorded for revisits. payloads=False leaves the bytes out.
    """
    schema = "file string, offset long, bytes long, record_type string, record_id string, uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, error string"

    def make():
        names = [x.split()[0] for x in schema.split(", ")]

        def one(batch):
            out: dict[str, list] = {k: [] for k in names}
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for offset, size, headers, payload, error in salvage(data):
                    if headers is None:
                        row = (path, offset, size, *[None] * 7, error)
                    else:
                        claimed = headers.get("warc-payload-digest", "")
                        if headers.get("warc-type") == "revisit":
                            length, sha1 = headers.get("warc-payload-length", ""), base64.b32decode(claimed[5:]).hex() if re.fullmatch("sha1:[A-Z2-7]{32}", claimed) else None
                            length = int(length) if re.fullmatch("[0-9]{1,18}", length) else None
                        else:
                            length, sha1 = len(payload), hashlib.sha1(payload).hexdigest()
                        refers_to = headers.get("warc-refers-to")
                        row = (path, offset, size, headers.get("warc-type"), headers.get("warc-record-id", "").strip("<>"), headers.get("warc-target-uri"), refers_to and refers_to.strip("<>"), payload if payloads else None, length, sha1, None)
                    for name, value in zip(names, row, strict=True):
                        out[name].append(value)
            return out

        return one

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    return _base.map_batches(files, make, schema)


def lost_files(written: DataFrame, found: DataFrame) -> DataFrame:
    """(file, records, read, gaps) of the written files that did not give back just what was put into them."""
    read = found.groupBy(F.element_at(F.split("file", "/"), -1).alias("file")).agg(F.count_if(F.col("record_type").isNotNull()).alias("read"), F.count_if(F.col("record_type").isNull()).alias("gaps"))
    both = written.join(read, "file", "left").fillna(0, ["read", "gaps"])
    return both.where("read <> records or gaps > 0").select("file", "records", "read", "gaps")


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder, read them back by the salvage reader.

    (page_id, payload_bytes, payload_digest, record_type, refers_to); an empty table gives an empty result. Only the files
    that the writer names count. Records and quarantined gaps are kept as a table beside the archives; a file that loses a
    record or has a gap is an error.
    """
    spark = pages.sparkSession
    folder = _base.scratch(spark, "warc")
    written = _base.save(write_archives(plan_records(pages, page_id, url, html), folder), "warc-files")
    if written.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    every = read_archives(spark, folder, payloads=False)
    named = every.join(written.select(F.col("file").alias("_file")), F.element_at(F.split("file", "/"), -1) == F.col("_file"), "left_semi")
    found = _base.save(named, "warc-records")
    if lost := lost_files(written, found).take(3):
        raise RuntimeError(f"archives do not give back what was written: {lost}")
    of = lambda c: F.regexp_extract(c, r"^urn:page:(-?[0-9]+)$", 1)
    number = lambda c: F.when(of(c) != "", of(c).cast("long"))
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))

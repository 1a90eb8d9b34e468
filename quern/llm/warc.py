"""WARC archives: a writer with revisits, and a reader that salvages what follows damage.

Writing: one record for each page, a gzip member each, in archives of about ``archive_bytes`` in a folder that all
executors share. Of pages with equal payloads of at least ``revisit_bytes`` bytes the one with the largest page_id becomes
the response and the others revisit it. A page needs only (SHA-1, size) to find its group; one maximum per group is taken
before the shuffle ends, so a hot payload is a few rows a task. Payloads that few share are not shuffled. An archive bears
its attempt's name, and the manifest that comes back names the archives of the attempts that counted: one that a lost or
repeated task left behind is never read.

Reading: an archive streams through a window. Members are unpacked and checked one by one (gzip checksum, version line,
header, length, payload digest). After a failed check the reader looks for the next gzip member or version line, takes up
again there, and reports the bytes between as a quarantined gap. Memory is bounded by one record of at most
``record_bytes``; a larger one is quarantined like a damaged one, and told by its reason. What is read back from archives
just written is counted against the manifest.

Defined results: a null html is the empty payload; a null page_id is kept and is never the target of a revisit unless its
whole group has none; of rows that repeat a page_id all with the largest are responses; page ids are whole numbers (a
TypeError otherwise); an empty table writes nothing and reads as an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import new_folder, prepare, staged, task, whole_ids

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_CHUNK = 1 << 16


@dataclass(frozen=True)
class WarcParams:
    revisit_bytes: int = 1000
    archive_bytes: int = 16_000_000
    level: int = 6
    record_bytes: int = 1 << 29
    #: Up to so many shared payloads' digests (50 MB) are sent to the pages; beyond, the larger pages are shuffled to them.
    sent: int = 500_000
    date: str = "2000-01-01T00:00:00Z"


# ---------------------------------------------------------------- records as bytes


def _urn(page) -> str:
    return f"<urn:page:{page}>"


def record_bytes(page, url: str | None, payload: bytes, refers_to, revisit: bool, date: str, digest: bytes | None = None) -> bytes:
    """One record, not compressed. A revisit holds the HTTP header alone, with the full payload's length and digest."""
    digest = digest or hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Damaged(ValueError):
    """A record fails a check."""


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a place, and the place after it."""
    if not _LINE.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header without an end")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise Damaged("no length")
    start, size = end + 4, int(head["content-length"])
    if start + size > len(data):
        raise Damaged("block is cut short")
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise Damaged("block has another length")
    block = data[start : start + size]
    if (want := head.get("warc-block-digest", "")).lower().startswith("sha1:") and base64.b32encode(hashlib.sha1(block).digest()).decode() != want[5:].upper():
        raise Damaged("block digest differs")
    kind = head.get("warc-type", "")
    out = {"record_type": kind, "page_id": _page(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "refers_to": _page(head.get("warc-refers-to")), "payload": None, "payload_bytes": None, "payload_digest": None}
    if kind in ("response", "revisit"):
        split = block.find(b"\r\n\r\n")
        if split < 0:
            raise Damaged("no HTTP header")
        payload = block[split + 4 :]
        if want := head.get("warc-payload-digest"):
            try:
                out["payload_digest"] = base64.b32decode(want.partition(":")[2].upper()).hex()
            except ValueError as e:
                raise Damaged("payload digest cannot be read") from e
        if kind == "response":
            own = hashlib.sha1(payload).hexdigest()
            if out["payload_digest"] not in (None, own):
                raise Damaged("payload digest differs")
            out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": own}
        elif m := re.search(rb"(?i)content-length:\s*(\d+)", block[:split]):
            out["payload_bytes"] = int(m[1])
    return out, start + size + 4


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


class _Window:
    """The part of a stream that is looked at, by places in the stream."""

    def __init__(self, read: Callable[[int], bytes], most: int):
        self.read, self.most = read, most
        self.held, self.base, self.ended = bytearray(), 0, False

    @property
    def limit(self) -> int:
        return self.base + len(self.held)

    def reach(self, end: int) -> None:
        while self.limit < end and not self.ended:
            part = self.read(_CHUNK)
            self.ended = not part
            self.held += part

    def part(self, a: int, b: int) -> bytes:
        self.reach(b)
        return bytes(self.held[a - self.base : b - self.base])

    def leave(self, at: int) -> None:
        """What lies before a place is done with."""
        if at - self.base >= _CHUNK or at == self.limit:
            del self.held[: at - self.base]
            self.base = at

    def find(self, what: bytes, at: int, most: int) -> int:
        """The next place of ``what`` within ``most`` bytes, or -1."""
        end = at + most
        while True:
            self.reach(min(at + _CHUNK, end))
            i = self.held.find(what, at - self.base, end - self.base)
            if i >= 0 or self.ended or self.limit >= end:
                return self.base + i if i >= 0 else -1
            at = max(at, self.limit - len(what) + 1)

    def next_start(self, at: int) -> int:
        """The next place where a member or a record may begin; the stream's end if there is none."""
        while True:
            self.reach(at + _CHUNK)
            found = [x for x in (self.held.find(MAGIC, at - self.base), self.held.find(VERSION, at - self.base)) if x >= 0]
            if found:
                return self.base + min(found)
            if self.ended:
                return self.limit
            at = max(at, self.limit - len(VERSION) + 1)
            self.leave(at)


def unpack_member(w: _Window, at: int) -> tuple[bytes, int]:
    """One gzip member's content, and the place after it; only a chunk at a time is handed to the decompressor."""
    d, out, fed, size = zlib.decompressobj(31), [], at, 0
    try:
        while not d.eof and (part := w.part(fed, fed + _CHUNK)):
            fed += len(part)
            while part and not d.eof:
                own = d.decompress(part, _CHUNK * 16)
                size += len(own)
                if size > w.most or fed - at > w.most + _CHUNK:
                    raise Damaged(f"member is larger than {w.most} bytes")
                out.append(own)
                part = d.unconsumed_tail
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from e
    if not d.eof:
        raise Damaged("gzip member is cut short")
    return b"".join(out), fed - len(d.unused_data)


def plain_record(w: _Window, at: int) -> tuple[dict, int]:
    """A record that isn't compressed, and the place after it."""
    end = w.find(b"\r\n\r\n", at, 1 << 20)
    if end < 0:
        raise Damaged("header without an end")
    length = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", w.part(at, end))
    size = int(length[1]) if length else 0
    if size > w.most:
        raise Damaged(f"record is larger than {w.most} bytes")
    record, used = parse_record(w.part(at, end + 8 + size), 0)
    return record, at + used


def salvage(source: bytes | Callable[[int], bytes], most: int = 1 << 29) -> Iterator[dict]:
    """Records ({"kind": "record", ...}) in order, and gaps ({"kind": "gap", "offset", "length", "reason"}) between them."""
    w = _Window(io.BytesIO(source).read if isinstance(source, bytes | bytearray | memoryview) else source, most)
    at, gap, reason = 0, None, ""

    def closed(end: int) -> Iterator[dict]:
        nonlocal gap
        if gap is not None and end > gap:
            yield {"kind": "gap", "offset": gap, "length": end - gap, "reason": reason}
        gap = None

    while True:
        w.reach(at + len(VERSION))
        if at >= w.limit:
            break
        try:
            if w.part(at, at + len(MAGIC)) == MAGIC:
                inner, end = unpack_member(w, at)
                whole = list(_records_of(inner))
                if not any(r["kind"] == "record" for r in whole):
                    raise Damaged(whole[0]["reason"] if whole else "empty member")
                yield from closed(at)
                for r in whole:  # places inside a member are told by the member's own
                    yield r | ({"offset": at} if r["kind"] == "record" else {"offset": at, "length": end - at, "reason": f"inside the member: {r['reason']}"})
            else:
                record, end = plain_record(w, at)
                yield from closed(at)
                yield {"kind": "record", "offset": at} | record
            at = end
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = w.next_start(at + 1)
        w.leave(at)
    yield from closed(at)


def _records_of(inner: bytes) -> Iterator[dict]:
    """Records of a member's content; after a failed check the next version line is tried."""
    at = 0
    while at < len(inner):
        try:
            record, end = parse_record(inner, at)
            yield {"kind": "record"} | record
            at = end
        except Damaged as e:
            following = inner.find(VERSION, at + 1)
            yield {"kind": "gap", "reason": str(e)}
            at = following if following >= 0 else len(inner)


# ---------------------------------------------------------------- tables


def revisit_targets(pages: DataFrame, p: WarcParams, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """digest, size and target (largest id) of each payload that several pages share."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    narrow = pages.select(F.col(id_col).alias("id"), F.sha1(body).alias("_digest"), F.octet_length(body).alias("_size"))
    groups = narrow.filter(F.col("_size") >= p.revisit_bytes).groupBy("_digest", "_size").agg(F.max("id").alias("_target"), F.count("*").alias("_n"))
    return groups.filter((F.col("_n") > 1) & F.col("_target").isNotNull()).drop("_n")


def write_archives(pages: DataFrame, folder: str, p: WarcParams | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes all pages; returns the manifest: each archive's name, size and record count."""
    p = p or WarcParams()
    whole_ids(pages, id_col)
    prepare(pages.sparkSession)
    body = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), body.alias("_body"), F.sha1(body.cast("binary")).alias("_digest"), F.octet_length(body).alias("_size"))
    targets = staged(revisit_targets(pages, p, id_col, payload_col), "targets")
    if targets.count() <= p.sent:
        rows = rows.join(F.broadcast(targets), ["_digest", "_size"], "left")
    else:
        small = F.col("_size") < p.revisit_bytes
        rows = rows.filter(~small).join(targets, ["_digest", "_size"], "left").unionByName(rows.filter(small).withColumn("_target", F.lit(None).cast(targets.schema["_target"].dataType)))
    target = F.when(~F.col("_target").eqNullSafe(F.col("_id")), F.col("_target"))
    # as text, for a number beside nulls would reach Python as a float
    rows = rows.select(F.coalesce(F.col("_id").cast("string"), F.lit("null")).alias("_id"), "_url", "_body", target.cast("string").alias("_target"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held, size, made = [], 0, 0

        def flush() -> pd.DataFrame:
            nonlocal held, size, made
            name = f"part-{context.partitionId():06d}-{made:04d}-{context.taskAttemptId()}.warc.gz"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                for member in held:
                    out.write(member)
            row = pd.DataFrame({"archive": [name], "bytes": [size], "records": [len(held)]})
            held, size, made = [], 0, made + 1
            return row

        for batch in batches:
            for page, url, text, target in zip(batch["_id"], batch["_url"], batch["_body"], batch["_target"], strict=True):
                revisit = isinstance(target, str)
                raw = record_bytes(page, url if isinstance(url, str) else None, text.encode("utf-8", "replace"), target if revisit else None, revisit, p.date)
                held.append(gzip.compress(raw, p.level, mtime=0))
                size += len(held[-1])
                if size >= p.archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return staged(rows.mapInPandas(task("warc", run), "archive string, bytes long, records long"), "archives")


_READ = "archive string, offset long, kind string, record_type string, page_id string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string, gap_bytes long, reason string"
_NAMES = [x.split()[0] for x in _READ.split(", ")]


def _rows_of(name: str, found: Iterator[dict], payload: bool) -> Iterator[pd.DataFrame]:
    """Records and gaps as frames of bounded size."""
    out, size = [], 0
    text = lambda x: None if x is None else str(x)
    for r in found:
        own = r.get("payload") if payload else None
        out.append((name, r["offset"], r["kind"], r.get("record_type"), text(r.get("page_id")), r.get("url"), own, r.get("payload_bytes"), r.get("payload_digest"), text(r.get("refers_to")), r["length"] if r["kind"] == "gap" else None, r.get("reason")))
        size += len(own or b"") + 200
        if size > 4_000_000:
            yield pd.DataFrame(out, columns=_NAMES).astype({c: "Int64" for c in ("offset", "payload_bytes", "gap_bytes")})
            out, size = [], 0
    if out:
        yield pd.DataFrame(out, columns=_NAMES).astype({c: "Int64" for c in ("offset", "payload_bytes", "gap_bytes")})


def read_archives(spark: SparkSession, folder: str, payload: bool = False, manifest: DataFrame | None = None, p: WarcParams | None = None) -> DataFrame:
    """Every record and every quarantined gap, told apart by ``kind``: of the manifest's archives, or of all in the folder.

    Archives are streamed by the executors where their file system can be opened there; a folder that only Spark reads
    takes ``binaryFile``, which holds an archive at a time.
    """
    p = p or WarcParams()

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["archive"]:
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    yield from _rows_of(name, salvage(f.read, p.record_bytes), payload)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["archive"], batch["content"], strict=True):
                yield from _rows_of(name, salvage(bytes(content), p.record_bytes), payload)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder) if manifest is None else None
    if not re.match(r"(file:|hdfs:|s3:|gs:|/)", folder):
        if files is None:
            files = spark.read.format("binaryFile").load(folder).withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(manifest.select("archive"), "archive", "left_semi")
        made = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").mapInPandas(task("warc", held), _READ)
    else:
        names = files.select(F.element_at(F.split("path", "/"), -1).alias("archive")) if manifest is None else manifest.select("archive")
        spread = names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive")
        made = spread.mapInPandas(task("warc", stream), _READ)
    return made.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, p: WarcParams | None = None) -> DataFrame:
    """Writes pages as archives and reads every record of the manifest back; damage or a wrong count is an error."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    manifest = write_archives(pages, folder, p)
    written = manifest.agg(F.sum("records").alias("n")).first()["n"] or 0
    if not written:
        return spark.createDataFrame([], _READ).withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})
    back = staged(read_archives(spark, folder, manifest=manifest, p=p), "records")
    found = {r["kind"]: r["count"] for r in back.groupBy("kind").count().collect()}
    if found != {"record": written}:
        raise RuntimeError(f"{written} records were written, and {found} read back")
    return back

"""WARC archives: a writer with revisits, and a salvage reader that steps over damage.

Writing: each page is one record, compressed as a gzip member of its own. Of pages with equal payloads
of at least ``least`` bytes the one with the smallest id is a response and the others revisit it; all
smaller payloads are responses. Digests are compared through a grouped minimum, so copies collapse
before they move. The payloads stay in their tasks unless there are more repeated digests than
``broadcast_rows``; then they meet them in a shuffled (skew-splitting) join. Members are written by
Spark's text writer as raw bytes; an empty member, which holds no record, ends every line.

Reading: a member or plain record counts only if its checksum, length, closing line ends and digests all
hold. After a failed check the reader searches for the next member magic or version line from which a
valid record can be read, goes on there, and logs the bytes between as a quarantined gap.
Inside a member the same search runs over the version lines of what can be decompressed, up to damage or
a cut; a gap there is logged by the offset of the member, where reading went on after it, and the
range of decompressed bytes. Of a member that is damaged only records with a digest of their own
that holds are reported (their heads are under no sum), and none if it is one record and its sum fails.

Defined cases: a null payload is empty. A null id is written as ``none`` and read back as null; it is
never the smallest unless all are null, and then all are responses. Repeated rows (same id and payload)
are each a response. Other columns are ignored; an empty table gives archives without records. A cut
archive yields the records before the cut and one gap; bytes that are no archive yield one gap.
Archives of up to the limit of Spark's binary reader (2 GB) can be read; ``per_archive`` bounds those
written here.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
URN = "urn:page:"
MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
#: Bytes fed to a decompressor at once.
FEED = 1 << 16
RECORD = (
    "archive string, offset long, record_type string, record_id string, target_uri string, "
    "payload_bytes long, payload_digest string, refers_to string, payload binary"
)


def member(data: bytes, level: int = 6) -> bytes:
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str
) -> bytes:
    """One whole record; ``first`` is the id of the response that a revisit refers to."""
    head = HTTP % len(payload)
    block = head if first is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    if first is not None:
        lines.append(f"WARC-Refers-To: <{URN}{first}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    date: str = "2000-01-01T00:00:00Z",
    least: int = 100,
    per_archive: int = 1000,
    broadcast_rows: int = 100_000,
) -> None:
    """Write ``pages`` (page_id, url, html) as archives below ``path``."""
    own = pages.select(
        "page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    shared = F.when(F.length("payload") >= least, F.col("digest"))
    firsts = (
        own.select("page_id", shared.alias("digest"))
        .where("digest is not null")
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("shared"), "first")
    )
    if firsts.limit(broadcast_rows + 1).count() <= broadcast_rows:
        firsts = F.broadcast(firsts)
    marked = own.join(firsts, shared == F.col("shared"), "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"),
    )

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            out = [member(record(*row, date)) for row in rows]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    (
        marked.mapInArrow(run, "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", member(b"").decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", per_archive)
        .text(path)
    )


class _Bad(Exception):
    pass


CUT, HURT, SUM = "member is cut off", "member is damaged", "sum of the member does not hold"


def _inflated(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at ``at``, where it ends, and why it is not whole; zlib checks sum and size."""
    begin, coder, parts = at, zlib.decompressobj(31), []
    while not coder.eof:
        if at >= len(data):
            return b"".join(parts), at, CUT
        piece = data[at : at + FEED]
        at += len(piece)
        try:
            parts.append(coder.decompress(piece))
        except zlib.error as e:
            ended = "incorrect data check" in str(e) or "incorrect length check" in str(e)
            return _prefix(data, begin), at, SUM if ended else HURT
    return b"".join(parts), at - len(coder.unused_data), None


def _fed(coder, piece) -> tuple:
    """The decompressor after ``piece`` and its output, or None."""
    after = coder.copy()
    try:
        return after, after.decompress(piece)
    except zlib.error:
        return after, None


def _prefix(data: memoryview, at: int) -> bytes:
    """What the damaged member at ``at`` holds before the first byte that cannot be decompressed."""
    coder, parts, size = zlib.decompressobj(31), [], FEED
    while size:
        after, out = _fed(coder, data[at : at + size])
        if out is None:
            size //= 2
        else:
            coder, at = after, at + size
            parts.append(out)
    rest = data[at : at + 1]
    while True:  # symbols that end inside that byte
        try:
            out = coder.decompress(rest, 1)
        except zlib.error:
            out = b""
        if not out:
            return b"".join(parts)
        parts.append(out)
        rest = coder.unconsumed_tail


def _reach(data: memoryview, at: int, want: int) -> int:
    """Where the compressed bytes end that make the first ``want`` bytes of the member at ``at``."""
    coder, have, size = zlib.decompressobj(31), 0, FEED
    while size:
        after, out = _fed(coder, data[at : at + size])
        if out is None or have + len(out) >= want:
            size //= 2
        else:
            coder, have, at = after, have + len(out), at + size
    return at + 1


def _parsed(data, at: int, proven: bool = False) -> tuple[tuple, int]:
    """The record at ``at`` of plain bytes, checked, and where it ends; ``proven``: some digest must hold."""
    text = bytes(data[at : at + len(VERSION)])
    if text != VERSION:
        raise _Bad("no version line")
    size = 1 << 12
    while (end := (head := bytes(data[at : at + size])).find(b"\r\n\r\n")) < 0:
        if at + size >= len(data):
            raise _Bad("head is cut off")
        size *= 4
    fields = {}
    try:
        version, *lines = head[:end].decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise _Bad("head is not text") from e
    if not re.fullmatch(r"WARC/1\.[0-9]", version):
        raise _Bad("no version line")
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[A-Za-z0-9-]+", name):
            raise _Bad("malformed field")
        fields[name.lower()] = value.strip()
    if not MANDATORY <= fields.keys():
        raise _Bad("a mandatory field is missing")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise _Bad("no content length")
    begin, stop = at + end + 4, at + end + 4 + int(length)
    if bytes(data[stop : stop + 4]) != b"\r\n\r\n":
        raise _Bad("record does not close at its length")
    block = bytes(data[begin:stop])
    sure = _checked(fields.get("warc-block-digest"), block)
    kind = fields.get("warc-type")
    payload, http = block, {}
    if fields.get("content-type", "").startswith("application/http"):
        top, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise _Bad("no message head")
        lines = (line.partition(":") for line in top.decode("latin-1").split("\r\n")[1:])
        http = {name.strip().lower(): value.strip() for name, _, value in lines}
    digest = fields.get("warc-payload-digest")
    if kind == "revisit":
        told = http.get("content-length", "")
        count = int(told) if told.isascii() and told.isdigit() else None
        payload = None
    else:
        sure |= _checked(digest, payload)
        count, digest = len(payload), f"sha256:{hashlib.sha256(payload).hexdigest()}"
    if proven and not sure:
        raise _Bad("no digest in a damaged member")
    bare = digest.partition(":")[2].lower() if digest else None
    names = (fields.get(k) for k in ("warc-record-id", "warc-target-uri"))
    refers = fields.get("warc-refers-to")
    return (kind, *names, count, bare, refers, payload), stop + 4


def _checked(digest: str | None, data: bytes) -> bool:
    """Whether ``digest`` proves ``data``; SHA-256 must, other kinds may be of another form of it."""
    kind, _, told = (digest or "").partition(":")
    kind, told = kind.strip().lower(), told.strip()
    if kind == "sha256" and hashlib.sha256(data).hexdigest() != told.lower():
        raise _Bad("digest does not match")
    if kind not in ("sha256", "sha1", "sha512", "md5"):
        return False
    own = hashlib.new(kind, data).digest()
    return told.lower() == own.hex() or told.upper() == base64.b32encode(own).decode()


def _inner(plain: bytes, proven: bool) -> tuple[list[tuple], list[tuple], int]:
    """Records and gaps (reason, start, end) of a member's content, and where the last record ends."""
    records, gaps, at, last, lost = [], [], 0, 0, None
    while at < len(plain):
        try:
            found, end = _parsed(plain, at, proven)
        except _Bad as e:
            lost = lost or (str(e), at)
            place = plain.find(VERSION, at + 1)
            at = place if place >= 0 else len(plain)
            continue
        if lost:
            gaps.append((*lost, at))
            lost = None
        records.append(found)
        at = last = end
    if lost:
        gaps.append((*lost, len(plain)))
    return records, gaps, last


def _unit(data: memoryview, at: int) -> tuple[list[tuple], int, list[tuple], bool]:
    """Records of the member at ``at``, or the one plain record there; where to go on, gaps, whether it is whole."""
    if bytes(data[at : at + len(MEMBER)]) != MEMBER:
        found, end = _parsed(data, at)
        return [found], end, [], True
    plain, end, why = _inflated(data, at)
    records, gaps, last = _inner(plain, why in (HURT, SUM))
    if not records and (why or gaps):
        raise _Bad(why or gaps[0][0])
    if why is None:
        return records, end, gaps, True
    if why == SUM and len(records) == 1 and not gaps:
        raise _Bad(why)
    gaps = [g for g in gaps if g[1] < last] + [(why, last, len(plain))]
    return records, _reach(data, at, last), gaps, False


def salvage(content: bytes) -> tuple[list[tuple], list[tuple]]:
    """Records (offset, ...) and gaps of one archive, in order.

    A gap is (start, end, reason), or (member, end, reason, inner start, inner end) inside a member.
    """
    data, records, gaps, at = memoryview(content), [], [], 0
    lost = None  # where an open gap began, and its reason and inner range, or those of several
    ahead = {MEMBER: -1, VERSION: -1}  # the next place of each, as far as known

    def onward(start: int) -> int:
        for magic, place in ahead.items():
            if place < start:
                place = content.find(magic, start)
                ahead[magic] = place if place >= 0 else len(content)
        return min(ahead.values())

    def close(end: int) -> None:
        gaps.extend((lost[0], end, *why) for why in lost[1])

    while at < len(content):
        try:
            found, end, inner, whole = _unit(data, at)
        except _Bad as e:
            lost = lost or (at, [(str(e),)])
            at = onward(at + 1)
            continue
        if lost and not found:  # an empty member proves nothing
            at = end
            continue
        if lost:
            close(at)
            lost = None
        records += [(at, *r) for r in found]
        if whole:
            gaps += [(at, end, *why) for why in inner]
            at = end
        else:
            lost = (at, inner)
            at = onward(end)
    if lost:
        close(len(content))
    return records, gaps


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records that can be read from the archives below ``path``."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = [(name, *r) for r in salvage(content.as_py())[0]]
                for k in range(0, len(rows), 200):
                    part = [list(c) for c in zip(*rows[k : k + 200])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, kind) for c, kind in zip(part, _KINDS)], names=_NAMES
                    )

    return _read(spark, path).select("path", "content").mapInArrow(run, RECORD)


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """The quarantined byte ranges of the archives below ``path``; inner ranges are null outside of members."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                gaps = [(name, *g, None, None)[:6] for g in salvage(content.as_py())[1]]
                if gaps:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*gaps), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    out = "archive string, start long, end long, reason string, inner_start long, inner_end long"
    names = [f.split(" ")[0] for f in out.split(", ")]
    return _read(spark, path).select("path", "content").mapInArrow(run, out)


_NAMES = [f.strip().split(" ")[0] for f in RECORD.split(",")]
_KINDS = [
    {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.strip().split(" ")[1]]
    for f in RECORD.split(",")
]


def page_of(urn):
    """The page id that a record id names."""
    return F.regexp_extract(urn, f"^<{URN}(-?[0-9]+)>$", 1).try_cast("long")

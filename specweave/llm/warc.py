"""WARC archives: distributed writer and sequential reader.

One gzip member holds one record.  The writer folds equal payloads into
``revisit`` records of one ``response``; revisits carry digests, not payloads, so
only the payloads of repeated digests are ever shuffled, dealt by page.  Writing tasks name their files anew
at each attempt and report them in a manifest; only files named in the
committed manifest are read, so a lost executor leaves no half archive behind.

The reader inflates members piece by piece and frames records by Content-Length;
several records in one member are read too.  It takes archives of other writers: records of any type, record ids
as text, block and payload digests by SHA-1, SHA-256, SHA-512 or MD5 in base32 or base16.  Digests of
other kinds, and payload digests of bodies with a transfer encoding, are not verified; any other
digest that doesn't hold ends the job, as does a record cut short.

Files are opened through ``pyarrow.fs``, so the folder may be any store that
executors share.

Defined cases: a null payload is empty; a null id is written as ``-`` and read
as null; a group whose ids are all null has only responses, as has the largest
id when it is repeated; a null or odd url is written without control
characters or left out; extra columns are ignored; an empty table gives no
archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .bytewords import tidy
from .common import fresh_path, staged, table

FILE_BYTES = 1 << 30
READ_BYTES = 1 << 18
BATCH_BYTES = 8 << 20
#: Tasks that the pages of one repeated payload are dealt to.
SALTS = 16
_EPOCH = "1970-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(kind: str, page: str, uri: str | None, refers_to: int | None, payload_digest: str, block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {_EPOCH}"]
    if uri:
        lines.append("WARC-Target-URI: " + "".join(c for c in uri if c >= " " and c != "\x7f"))
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None, size: int | None = None) -> bytes:
    """One gzip member.  A revisit keeps the HTTP header, which tells the payload's length, without the payload; it needs only ``digest`` and ``size``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    record = _header(kind, "-" if page_id is None else str(page_id), url, refers_to, digest or sha1_base32(payload), block) + block + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(record) + gz.flush()


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, sha1, bytes, refers_to) of ``pages`` (page_id, url, html).

    refers_to: the largest id of equal payloads of ``min_bytes`` or more; html is null where it is set.  Pages
    whose digest a bounded Bloom filter of repeated digests clears stay where they are.
    """
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"))
    own = own.withColumns({"key": F.sha2(F.col("html").cast("binary"), 256), "sha1": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    narrow = staged(own.select("page_id", "key", "bytes"), "digests")
    many = narrow.where(F.col("bytes") >= min_bytes).groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1").select("key", "keeper")
    many = staged(many, "repeated")
    n = bloom.blocks_for(many.count())
    # the commonest payload's pages are dealt to several tasks
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")
    dealt = many.select("key", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    other = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))
    again = narrow.select("page_id", "key", salt("page_id")).join(dealt, ["key", "salt"]).where(other).select(F.col("page_id").alias("p"), F.col("key").alias("k"), F.col("keeper").alias("refers_to")).distinct()
    tried = bloom.probe(own, "key", bloom.build(many, "key", n), n)
    alone = tried.where("not maybe").withColumn("refers_to", F.lit(None).cast("long"))
    rest = tried.where("maybe").join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("key") == F.col("k")), "left")
    rest = rest.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    names = ["page_id", "url", "html", "sha1", "bytes", "refers_to"]
    return alone.select(*names).unionByName(rest.select(*names))


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the rows of ``with_revisits`` below ``folder``; gives the manifest (path, records, bytes)."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, n, size = None, None, 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, url, html, sha1, length, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "bytes", "refers_to"))):
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                member = record_bytes(page_id, url, (html or "").encode(), refers_to, base64.b32encode(bytes.fromhex(sha1)).decode(), length)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "records", "bytes"])

    return staged(rows.mapInArrow(tidy(run), "path string, records long, bytes long"), "warc-manifest")


def members(stream, read_bytes: int = READ_BYTES) -> Iterator[Iterator[bytes]]:
    """For each gzip member of ``stream`` its decompressed pieces; compressed input is read bit by bit."""
    rest = b""
    while True:
        rest = rest or stream.read(read_bytes)
        if not rest:
            return
        inflate = zlib.decompressobj(31)

        def pieces(first: bytes) -> Iterator[bytes]:
            nonlocal rest
            data = first
            while True:
                piece = inflate.decompress(data, read_bytes)
                if piece:
                    yield piece
                if inflate.eof:
                    rest = inflate.unused_data
                    return
                data = inflate.unconsumed_tail or stream.read(read_bytes)
                if not data and not piece:
                    raise ValueError("the archive ends within a gzip member")

        own = pieces(rest)
        yield own
        for _ in own:  # what the caller left
            pass


def _take(pieces: Iterator[bytes], have: bytearray, until: bytes) -> bytes:
    """Bytes up to and with ``until``; what follows stays in ``have``."""
    at = have.find(until)
    while at < 0:
        piece = next(pieces, None)
        if piece is None:
            raise ValueError("a record ends within its header")
        start = max(0, len(have) - len(until))
        have += piece
        at = have.find(until, start)
    head = bytes(have[: at + len(until)])
    del have[: at + len(until)]
    return head


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    """(first line, fields by lower-case name); folded lines are joined, bytes that aren't UTF-8 are read as Latin-1."""
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    first, *lines = re.sub(r"\r\n[ \t]+", " ", text).rstrip("\r\n").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


#: Digest algorithms by label, and their bytes.
_ALGORITHMS = {"sha1": 20, "sha-1": 20, "sha256": 32, "sha-256": 32, "sha512": 64, "sha-512": 64, "md5": 16}


class _Digests:
    """What a header says of some bytes, held against them as they come."""

    def __init__(self, said: str | None):
        name, _, value = (said or "").partition(":")
        size = _ALGORITHMS.get(name.strip().lower())
        self.value = value.strip()
        self.hash = hashlib.new(name.strip().lower().replace("-", "")) if size else None
        self.sixteen = bool(size) and len(self.value.rstrip("=")) == 2 * size

    def update(self, data: bytes) -> None:
        if self.hash:
            self.hash.update(data)

    def holds(self) -> bool:
        if not self.hash:
            return True
        if self.sixteen:
            return self.hash.hexdigest() == self.value.lower()
        return base64.b32encode(self.hash.digest()).decode().rstrip("=") == self.value.upper().rstrip("=")


def page_of(uri: str | None) -> int | None:
    """The page number in a record id of our own writer."""
    found = re.fullmatch(r"<?urn:page:(-?[0-9]+)>?", uri or "")
    return int(found[1]) if found else None


def read_record(pieces: Iterator[bytes], keep_payload: bool = True, have: bytearray | None = None) -> dict:
    """One record, framed by its Content-Length; its digests must hold.  ``have``: bytes read ahead, before and after."""
    have = bytearray() if have is None else have
    version, head = _fields(_take(pieces, have, b"\r\n\r\n"))
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    kind, left = head.get("warc-type", "").lower(), int(head["content-length"])
    has_http = head.get("content-type", "").lower().replace(" ", "").startswith("application/http")
    block, payload, sha1 = _Digests(head.get("warc-block-digest")), _Digests(head.get("warc-payload-digest")), hashlib.sha1()
    http: dict[str, str] | None = None if has_http else {}
    kept, front, size = bytearray(), bytearray(), 0
    while left:
        if not have:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError("a record is shorter than its Content-Length")
            have += piece
        part = bytes(have[:left])
        del have[: len(part)]
        left -= len(part)
        block.update(part)
        if http is None:
            start = max(0, len(front) - 3)
            front += part
            at = front.find(b"\r\n\r\n", start)
            if at < 0:
                continue
            _, http = _fields(bytes(front[: at + 4]))
            part = bytes(front[at + 4 :])
        payload.update(part)
        sha1.update(part)
        size += len(part)
        if keep_payload:
            kept += part
    while len(have) < 4 and (piece := next(pieces, None)) is not None:
        have += piece
    if bytes(have[:4]) != b"\r\n\r\n":
        raise ValueError("a record doesn't end after its Content-Length")
    del have[:4]
    whole = kind != "revisit" and "transfer-encoding" not in (http or {})
    if not block.holds() or (whole and not payload.holds()):
        raise ValueError(f"a digest of {head.get('warc-record-id')} doesn't hold")
    said = head.get("warc-payload-digest")
    digest = said.removeprefix("sha1:") if said else base64.b32encode(sha1.digest()).decode()
    full = int(http["content-length"]) if kind == "revisit" and http and http.get("content-length", "").isdigit() else size
    return {
        "record_id": head.get("warc-record-id"), "record_type": kind, "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "content_type": head.get("content-type"),
        "payload_bytes": full, "payload_digest": digest, "refers_to_record": head.get("warc-refers-to"), "page_id": page_of(head.get("warc-record-id")), "refers_to": page_of(head.get("warc-refers-to")),
        "payload": bytes(kept) if keep_payload and kind != "revisit" else None,
    }


def read_records(pieces: Iterator[bytes], keep_payload: bool = True) -> Iterator[dict]:
    """All records of one gzip member."""
    have = bytearray()
    while True:
        yield read_record(pieces, keep_payload, have)
        if not have:
            piece = next(pieces, None)
            if piece is None:
                return
            have += piece


_COLUMNS = {
    "record_id": pa.string(), "record_type": pa.string(), "url": pa.string(), "date": pa.string(), "content_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "refers_to_record": pa.string(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary(),
}
_SQL_TYPES = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of all archives of ``manifest`` (path), in the store of ``folder``, one file after another in each task."""
    columns = {c: t for c, t in _COLUMNS.items() if payloads or c != "payload"}

    def rows_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in columns.items()], list(columns))

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for pieces in members(stream):
                        for record in read_records(pieces, payloads):
                            rows.append(record)
                            size += 400 + len(record["payload"] or b"")
                            if size >= BATCH_BYTES:
                                yield rows_of(rows)
                                rows, size = [], 0
                if rows:
                    yield rows_of(rows)

    files = max(1, manifest.count())
    return manifest.select("path").repartitionByRange(files, "path").mapInArrow(tidy(run), ", ".join(f"{c} {_SQL_TYPES[t]}" for c, t in columns.items()))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    manifest = write_archives(with_revisits(table(spark, sf_dir, "pages")), folder)
    return read_archives(spark, manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes,
       x.digest AS payload_digest,
       CASE WHEN g.keeper IS NULL OR g.keeper IS NOT DISTINCT FROM p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.keeper IS NULL OR g.keeper IS NOT DISTINCT FROM p.page_id THEN NULL ELSE g.keeper END AS refers_to
FROM p JOIN g ON p.h = g.h,
LATERAL (SELECT list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(b.bits, 5 * k + 1, 1) AS INT) + 8 * CAST(substr(b.bits, 5 * k + 2, 1) AS INT) + 4 * CAST(substr(b.bits, 5 * k + 3, 1) AS INT)
      + 2 * CAST(substr(b.bits, 5 * k + 4, 1) AS INT) + CAST(substr(b.bits, 5 * k + 5, 1) AS INT) AS INT), 1)), 'string_agg', '') AS digest
  FROM (SELECT list_aggregate(list_transform(range(0, 40), lambda i: list_extract(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'],
    CAST(strpos('0123456789abcdef', substr(sha1(p.h), CAST(i + 1 AS INT), 1)) AS INT))), 'string_agg', '') AS bits) b) x
"""

"""WARC records in ZIP archives: writer, and a reader that range-reads records without extraction.

An archive holds stored (uncompressed) members: ``archive/data.warc.gz``, in which every record is a gzip
member of its own, and ``indexes/index.cdx`` with one line ``offset length`` per record. The reader works in
two jobs. The first reads the end of each archive, follows the ZIP64 locator where there is one, parses the
central directory, finds where each stored member begins, and reads the index; it returns byte ranges of some
megabytes that begin and end with a record. The second is dealt evenly over these ranges and reads each with one
request. Archives of others may bring a CDXJ index (``*.cdxj``, plain or gzipped) instead. A member that no index lists is
one range; it is read in slices, so that a task holds one slice and one record, whatever the size of the member.

Archives are opened with pyarrow's file systems, so paths may be local, on HDFS or in an object store.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import posixpath
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, new_path, ship_package

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: bytes of records after which a task begins another archive, and bytes of one range
ARCHIVE_BYTES, RANGE_BYTES = 256 << 20, 8 << 20
#: payload bytes after which a batch is handed to Spark
BATCH_BYTES = 16 << 20
#: bytes read from an archive, given to and taken from a gzip member at a time; largest header of a record
SLICE_BYTES, FEED_BYTES, PIECE_BYTES, HEADER_BYTES = 8 << 20, 1 << 14, 1 << 20, 1 << 20
REVISIT_BYTES = 1000
_LEVEL = 6


# ---- records ----


def _header(fields: list[tuple[str, str]], first: str) -> bytes:
    lines = [first, *(f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A") for k, v in fields)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def warc_record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response, or a revisit without the payload; the HTTP header keeps the length of the payload."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    if refers_to is not None:
        fields.append(("WARC-Refers-To", f"<{refers_to}>"))
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _header(fields, "WARC/1.1") + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC header, HTTP header and payload of each record in uncompressed WARC data, cut into pieces anywhere.

    One record is held at a time. Data that end inside a record raise an error.
    """
    held, at, need = bytearray(), 0, 0
    for piece in pieces:
        done = min(at, len(held))
        del held[:done]
        at -= done
        held += piece
        while len(held) > at and len(held) - at >= need:
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                if len(held) - at > HEADER_BYTES:
                    raise ValueError("no record header where one should begin")
                break
            warc = _fields(held[at:end])
            begin, length = end + 4, int(warc["content-length"])
            need = begin + length - at
            if len(held) - at < need:
                break
            block = bytes(held[begin : begin + length])
            head, found, payload = block.partition(b"\r\n\r\n")
            yield warc, _fields(head) if found else {}, payload if found else block
            at, need = begin + length + 4, 0
    if len(held) > at:
        raise ValueError("a record ends beyond its range")


def _unpacked(slices: Iterable[bytes]) -> Iterator[bytes]:
    """Uncompressed data in pieces of bounded size; gzip members may begin and end anywhere.

    A gzip member hands back what follows it, so it is fed little at a time.
    """
    member, packed = None, None
    for data in slices:
        if packed is None:
            packed = data[:2] == b"\x1f\x8b"
        if not packed:
            yield data
            continue
        for at in range(0, len(data), FEED_BYTES):
            piece, more = data[at : at + FEED_BYTES], False
            while piece or more:
                member = member or zlib.decompressobj(31)
                out = member.decompress(piece, PIECE_BYTES)
                if out:
                    yield out
                more = len(out) == PIECE_BYTES and not member.eof
                piece = member.unused_data if member.eof else member.unconsumed_tail
                if member.eof:
                    member = None
    if member is not None:
        raise ValueError("a gzip member ends beyond its range")


# ---- ZIP directories ----


def _range(file: pa.NativeFile, start: int, length: int) -> bytes:
    data = file.read_at(length, start)
    if len(data) < length:
        raise ValueError("the archive is shorter than its directory says")
    return data


def _central_directory(file: pa.NativeFile) -> tuple[int, int]:
    """Offset and size of the central directory, from the end record or the ZIP64 end record."""
    size = file.size()
    tail_at = max(size - 65_557, 0)
    tail = _range(file, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    length, offset = struct.unpack_from("<II", tail, at + 12)
    locator = tail_at + at - 20
    if locator >= 0:
        magic, _, end64, _ = struct.unpack("<4sIQI", _range(file, locator, 20))
        if magic == b"PK\x06\x07":
            record = _range(file, end64, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator points to no end record")
            length, offset = struct.unpack_from("<QQ", record, 40)
    return offset, length


def zip_members(file: pa.NativeFile) -> dict[str, tuple[int, int, int]]:
    """Name -> (compression method, offset of the data, stored size) of each member."""
    offset, length = _central_directory(file)
    directory, at, members = _range(file, offset, length), 0, {}
    while at < len(directory):
        magic, method, stored, size, n_name, n_extra, n_comment, local = struct.unpack_from(
            "<4s6xH8xIIHHH8xI", directory, at
        )
        if magic != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: 64-bit values for the fields that are all ones, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                size = next(wide) if size == 0xFFFFFFFF else size
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                local = next(wide) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        magic, n_local, n_more = struct.unpack("<4s22xHH", _range(file, local, 30))
        if magic != b"PK\x03\x04":
            raise ValueError("the central directory points to no member")
        members[name] = (method, local + 30 + n_local + n_more, stored)
        at += 46 + n_name + n_extra + n_comment
    return members


def _open(path: str) -> pa.NativeFile:
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _stored(members: dict, name: str) -> tuple[int, int]:
    method, start, size = members[name]
    if method:
        raise ValueError(f"member {name} is compressed, not stored")
    return start, size


def _slices(file: pa.NativeFile, start: int, length: int) -> Iterator[bytes]:
    for at in range(start, start + length, SLICE_BYTES):
        yield _range(file, at, min(SLICE_BYTES, start + length - at))


def _cdxj(file: pa.NativeFile, members: dict) -> dict[str, list[tuple[int, int]]]:
    """File name -> offset and length of its records, from the CDXJ indexes of an archive, which may be gzipped."""
    found: dict[str, list[tuple[int, int]]] = {}
    for name in members:
        if not name.endswith((".cdxj", ".cdxj.gz")):
            continue
        data = _range(file, *_stored(members, name))
        for line in (gzip.decompress(data) if name.endswith(".gz") else data).splitlines():
            at = line.find(b"{")
            if at < 0 or line.startswith(b"!"):
                continue
            entry = json.loads(line[at:])
            if "offset" in entry and "length" in entry:
                place = int(entry["offset"]), int(entry["length"])
                found.setdefault(posixpath.basename(entry.get("filename", "")), []).append(place)
    return found


def _record_places(file: pa.NativeFile, members: dict, name: str, cdxj: dict) -> list[tuple[int, int]]:
    """Offset and length of records of a member in ascending order; none if no index lists them."""
    index = INDEX if name == DATA else name + ".cdx"
    if index in members:
        lines = _range(file, *_stored(members, index)).split(b"\n")[:-1]
        return sorted((int(begin), int(length)) for begin, length in map(bytes.split, lines))
    return sorted(cdxj.get(posixpath.basename(name), []))


def _ranges(range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with _open(path) as file:
                    members = zip_members(file)
                    cdxj = _cdxj(file, members)
                    for name in members:
                        if not name.endswith((".warc", ".warc.gz")):
                            continue
                        start, size = _stored(members, name)
                        cuts = [0]
                        for begin, length in _record_places(file, members, name, cdxj):
                            if begin + length - cuts[-1] >= range_bytes:
                                cuts.append(begin + length)
                        if cuts[-1] < size:
                            cuts.append(size)
                        rows += [(path, start + a, b - a) for a, b in zip(cuts, cuts[1:])]
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "start", "length"])

    return run


_RECORD = pa.schema(
    [
        ("path", pa.string()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("refers_to", pa.string()),
        ("url", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _plain(value: str | None) -> str | None:
    return None if value is None else value.strip("<>")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length"))):
            rows, held = [], 0
            with _open(path) as file:
                for warc, http, payload in parse_records(_unpacked(_slices(file, start, length))):
                    revisit = warc["warc-type"] == "revisit"
                    digest = warc.get("warc-payload-digest", "").removeprefix("sha1:")
                    if not revisit and digest != (actual := hashlib.sha1(payload).hexdigest()):
                        raise ValueError(f"{path}: payload digest {actual} instead of {digest}")
                    rows.append(
                        {
                            "path": path,
                            "record_type": warc["warc-type"],
                            "record_id": _plain(warc.get("warc-record-id")),
                            "refers_to": _plain(warc.get("warc-refers-to")),
                            "url": warc.get("warc-target-uri"),
                            "payload_digest": digest,
                            "payload_bytes": int(http.get("content-length", 0)) if revisit else len(payload),
                            "payload": None if revisit else payload,
                        }
                    )
                    held += len(payload)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, _RECORD)


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All WARC records of the ZIP archives named in ``archives (path)``.

    Columns: ``path, record_type, record_id, refers_to, url, payload_digest, payload_bytes, payload``. A revisit has
    a NULL payload, and the digest and length of the full one. Compressed members, damaged directories
    and payloads that do not have their digest raise an error.
    """
    spark = archives.sparkSession
    ship_package(spark)
    ranges = archives.select("path").mapInArrow(_ranges(range_bytes), "path string, start bigint, length bigint")
    ranges = materialize(ranges, "ranges")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kinds = "path string, record_type string, record_id string, refers_to string, url string, payload_digest string"
    return ranges.repartition(tasks, "path", "start").mapInArrow(_read, f"{kinds}, payload_bytes bigint, payload binary")


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        archive, paths = None, []

        def finish():
            out, member, raw, index = archive
            member.close()
            with out.open(INDEX, "w") as lines:
                lines.writelines(index)
            out.close()
            raw.close()

        for batch in batches:
            for i in range(batch.num_rows):
                if archive is None:
                    # a name of its own for every attempt; only archives that the task reports are read
                    paths.append(f"{folder}/{uuid.uuid4().hex}.zip")
                    raw = system.open_output_stream(fs.FileSystem.from_uri(paths[-1])[1])
                    out = zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED)
                    member, at, index = out.open(DATA, "w", force_zip64=True), 0, []
                    archive = (out, member, raw, index)
                record_id, url, payload, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                pack = zlib.compressobj(_LEVEL, wbits=31)
                record = pack.compress(warc_record(record_id, url, payload, digest, refers_to)) + pack.flush()
                member.write(record)
                index.append(b"%d %d\n" % (at, len(record)))
                at += len(record)
                if at >= archive_bytes:
                    finish()
                    archive = None
        if archive is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return run


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``records (record_id, url, payload, digest, refers_to)`` and return the ``path`` of each archive.

    A record with ``refers_to`` is a revisit. The list of archives is a written table: archives of attempts
    that were lost or repeated are not in it.
    """
    ship_package(records.sparkSession)
    rows = records.select("record_id", "url", "payload", "digest", "refers_to")
    return materialize(rows.mapInArrow(_write(folder, archive_bytes), "path string"), "archives")


# ---- pages ----


def page_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """WARC records of ``pages (page_id, url, html)``.

    Of equal payloads of at least ``least`` bytes, the page with the largest id is the response and the others
    revisit it. A NULL html is an empty payload. Pages with a NULL id revisit any page with an id; among
    themselves they are all responses, as are repeated rows of the largest id.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long_ = rows.select("page_id", "digest", F.length("payload").alias("n")).filter(F.col("n") >= least)
    first = long_.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    first = first.filter("copies > 1").select("digest", "first")
    joined = rows.join(materialize(first, "responses"), "digest", "left")
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select(
        _record_id(F.col("page_id")).alias("record_id"),
        "url",
        "payload",
        "digest",
        F.when(other, _record_id(F.col("first"))).alias("refers_to"),
    )


_URN = "urn:page:"


def _record_id(page_id):
    return F.concat(F.lit(_URN), F.coalesce(page_id.cast("string"), F.lit("")))


def _page_id(record_id: str):
    number = F.substr(record_id, F.lit(len(_URN) + 1))
    return F.when(number != "", number.cast("bigint"))


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back, with ids as numbers."""
    archives = write_archives(page_records(pages), new_path(spark, "warc"))
    return read_archives(archives).select(
        _page_id("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        _page_id("refers_to").alias("refers_to"),
        "url",
        "payload",
    )

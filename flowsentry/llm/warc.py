"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record.

Archives travel as rows (archive, content): `write_archives` packs pages into them inside Spark,
`save_archives` puts them into a folder as .warc.zst files and `load_archives` reads such files,
whoever wrote them. `read_records` decodes any such rows, whatever the records' types and ids;
`read_archives` reads the pages back. The reader finds each frame's end from its block headers,
decodes one frame per record, skips further skippable frames, and validates the WARC headers, the
declared lengths and the digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.session import cut

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGICS = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
DICT_MAGIC = 0xEC30A437
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SUFFIX = ".warc.zst"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Payload bytes after which an archive is closed; records that train its dictionary, bytes of each, and the dictionary's size.
ARCHIVE_BYTES = 4 << 20
TRAINING_RECORDS = 64
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 8 << 10
LEVEL = 1


class BadArchive(ValueError):
    """An archive or record that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str, payload: bytes | None, size: int, digest: str, refers_to: int | None = None, mark: str = "") -> bytes:
    """One record; without a payload a revisit, which keeps the HTTP header with the payload's length. `mark` tells records of one page id apart."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}{mark}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if payload is None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record; raises BadArchive if anything is amiss."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (VERSION, b"WARC/1.0"):
        raise BadArchive("no WARC version line or no end of headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise BadArchive(f"header without a colon: {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [k for k in REQUIRED if k not in headers]:
        raise BadArchive(f"missing headers: {missing}")
    if not headers["content-length"].isdigit():
        raise BadArchive("Content-Length is not a number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"record of {len(rest)} bytes after its headers, {length} declared")
    return headers, rest[:length]


def read_response(headers: dict[str, str], block: bytes) -> tuple[int, str]:
    """(payload length, digest) of a response or revisit, checked against what the block holds."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    declared = http.get(b"content-length", b"")
    if not gap or not declared.isdigit():
        raise BadArchive("HTTP headers without an end or a length")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise BadArchive("a revisit with a payload or without WARC-Refers-To")
    elif len(payload) != int(declared) or payload_digest(payload) != digest:
        raise BadArchive("the payload differs from its declared length or digest")
    return int(declared), digest


def check_digest(name: str, declared: str | None, data: bytes) -> None:
    """Raise BadArchive if a SHA-1 digest in base32 or hexadecimal differs from the data; other algorithms are not checked."""
    if declared and declared.lower().startswith("sha1:"):
        value = declared[5:]
        if value.upper() != payload_digest(data) and value.lower() != hashlib.sha1(data).hexdigest():
            raise BadArchive(f"the {name} differs from its declared digest")


def read_payload(headers: dict[str, str], block: bytes) -> bytes:
    """The payload of any record: what follows the HTTP header of an HTTP message, nothing of a revisit, else the block.

    Digests of the block and, where the payload is there, of the payload are checked. An HTTP
    Content-Length is not: crawlers store bodies as they came over the wire, chunked or cut.
    """
    check_digest("block", headers.get("warc-block-digest"), block)
    if headers["warc-type"] == "revisit":
        return b""
    payload = block
    if headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise BadArchive("HTTP headers without an end")
    if "warc-segment-number" not in headers and "warc-truncated" not in headers:  # the digest is that of the whole payload
        check_digest("payload", headers.get("warc-payload-digest"), payload)
    return payload


def frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame that starts at `at`, from its headers only."""
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise BadArchive(f"no frame at byte {at}")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    size = (0 if not single else 1, 2, 4, 8)[flags >> 6]
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size
    last = False
    while not last:
        if at + 3 > len(data):
            raise BadArchive("a frame ends inside a block header")
        header = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        last, kind = bool(header & 1), header >> 1 & 3
        if kind == 3:
            raise BadArchive("reserved block type")
        at += 3 + (1 if kind == 1 else header >> 3)
    at += 4 * checksum
    if at > len(data):
        raise BadArchive("the archive ends inside a frame")
    return at


def open_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive."""
    data, at, dictionary = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data, 0)[0] == DICTIONARY_MAGIC:
        length = struct.unpack_from("<I", data, 4)[0]
        at = 8 + length
        if at > len(data):
            raise BadArchive("the dictionary frame is cut off")
        raw = bytes(data[8:at])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if raw[:4] != struct.pack("<I", DICT_MAGIC):
            raise BadArchive("the leading frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if len(data) >= at + 8 and struct.unpack_from("<I", data, at)[0] in SKIPPABLE_MAGICS:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at > len(data):
                raise BadArchive("the archive ends inside a skippable frame")
            continue
        end = frame_end(data, at)
        try:
            yield parse_record(decoder.decompressobj().decompress(data[at:end]))
        except zstandard.ZstdError as error:
            raise BadArchive(f"frame at byte {at}: {error}") from error
        at = end


def seal_archive(records: list[bytes]) -> bytes:
    """The archive of some records: a dictionary trained on the first of them, if there is enough to train on."""
    samples = [r[:SAMPLE_BYTES] for r in records[:TRAINING_RECORDS]]
    dictionary = None
    if len(samples) >= 8 and sum(map(len, samples)) >= 8 * DICTIONARY_BYTES:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
        except zstandard.ZstdError:  # samples too alike: the archive does without
            dictionary = None
    encoder = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    frames = [encoder.compress(r) for r in records]
    if dictionary is not None:
        raw = dictionary.as_bytes()
        frames.insert(0, struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    return b"".join(frames)


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def write_archives(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(archive, content, records): archives of about ARCHIVE_BYTES with one record per row of `pages`.

    Of records with equal payloads of at least `min_bytes` bytes the one with the smallest id is a
    response and the others revisit it. Only digests and ids are compared; a revisit leaves its
    payload behind before the shuffle. Null payloads are empty. Rows with the smallest id are all
    responses (repeated rows); a row without an id revisits, but is never referred to. Long
    payloads are one record each, whatever their size. A record is named after its page; names of
    rows without an id or with a repeated one go on with the place they are written at, so that no
    name is given twice.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), _payload(F.col(payload_col)).alias("html"))
    keyed = rows.withColumn("_sha", F.sha1("html"))
    names = cut(keyed.select("page_id", "_sha", F.octet_length("html").alias("_size")))
    firsts = names.where((F.col("_size") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # A digest with a single id needs no join; rows without an id are looked up as well.
    shared = firsts.join(names.where("page_id is null").select("_sha", F.lit(True).alias("_anon")).distinct(), "_sha", "left").where((F.col("_n") > 1) | F.col("_anon")).select("_sha", "_first")
    again = names.join(shared, "_sha").where((F.col("_size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))).select("page_id", "_sha", "_first")
    repeated = names.where("page_id is not null").groupBy("page_id").count().where("count > 1").select("page_id")
    again = again.withColumn("_repeated", F.lit(False)).unionByName(names.join(repeated, "page_id").select("page_id", "_sha", F.lit(None).cast(names.schema["page_id"].dataType).alias("_first"), F.lit(True).alias("_repeated")))
    again = again.groupBy("page_id", "_sha").agg(F.max("_first").alias("_first"), F.max("_repeated").alias("_repeated")).alias("a")
    k = keyed.alias("k")
    joined = k.join(again, F.col("k.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("k._sha") == F.col("a._sha")), "left")
    record = joined.select("k.page_id", "k.url", F.when(F.col("a._first").isNull(), F.col("k.html")).alias("html"), F.octet_length("k.html").cast("long").alias("size"), F.col("k._sha").alias("sha"), F.col("a._first").alias("refers_to"), (F.coalesce("a._repeated", F.lit(False)) | F.col("k.page_id").isNull()).alias("marked"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        held, part, lead, place, task = 0, 0, None, 0, TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            nonlocal records, held, part, lead
            content = seal_archive(records)
            name = f"{lead}-{task}-{part:06d}"
            out = pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([content], pa.binary()), pa.array([len(records)], pa.int64())], ["archive", "content", "records"])
            records, held, part = [], 0, part + 1
            return out

        for batch in batches:
            ids, urls, sizes, shas, refers, marked = (batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5, 6))
            for i, html in enumerate(batch.column(2).cast(pa.binary())):
                digest = base64.b32encode(bytes.fromhex(shas[i])).decode()
                lead = lead or f"{shas[i][:12]}-{ids[i]}"
                record = build_record(ids[i], urls[i], html.as_py(), sizes[i], digest, refers[i], f":{task}-{place}" if marked[i] else "")
                place += 1
                records.append(record)
                held += len(record)
                if held >= ARCHIVE_BYTES:
                    yield close()
        if records:
            yield close()

    return record.mapInArrow(run, "archive string, content binary, records long")


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(path, bytes): writes each archive row as <folder>/<archive>.warc.zst, a path or URI that every executor can write to.

    A file appears under its name when it is whole; a task that runs again writes the same names.
    Null names or contents raise; an empty table writes nothing. The files are written when the
    result is computed.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pa.fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = f"{base}/{re.sub(r'[^A-Za-z0-9._-]', '_', name)}{SUFFIX}"
                files.create_dir(base, recursive=True)
                with files.open_output_stream(f"{path}.{attempt}.part") as out:
                    out.write(content.as_buffer())
                files.move(f"{path}.{attempt}.part", path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(content.as_buffer())], pa.int64())], ["path", "bytes"])

    return archives.select("archive", "content").mapInArrow(run, "path string, bytes long")


def load_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, content): the .warc.zst files below a folder; archive is the file's path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.col("path").alias("archive"), "content")


#: Columns of `read_records` and the headers they come from.
FIELDS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri", "content_type": "content-type",
    "refers_to": "warc-refers-to", "declared_digest": "warc-payload-digest",
}


def read_records(archives: DataFrame, name_col: str = "archive", content_col: str = "content") -> DataFrame:
    """One row per record of any type: archive, place (from 0), the FIELDS (null if absent), all headers, payload, payload_bytes, payload_digest.

    `payload` is what `read_payload` returns; payload_digest is its SHA-1 in base32. A malformed
    archive or record raises BadArchive and so fails its task: nothing is skipped. Null or empty
    content has no records; an empty table gives an empty result; other columns are not read.
    """
    names = ["archive", "place", *FIELDS, "headers", "payload", "payload_bytes", "payload_digest"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * len(FIELDS), pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for place, (headers, block) in enumerate(open_archive(content.as_py() or b"")):
                    payload = read_payload(headers, block)
                    rows.append((name, place, *[headers.get(h) for h in FIELDS.values()], list(headers.items()), payload, len(payload), payload_digest(payload)))
                    held += len(payload)
                    if held >= ARCHIVE_BYTES:  # an archive inflates: give its records on in parts
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    texts = ", ".join(f"{f} string" for f in FIELDS)
    return archives.select(name_col, content_col).mapInArrow(run, f"archive string, place long, {texts}, headers map<string,string>, payload binary, payload_bytes long, payload_digest string")


def read_archives(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): one row per response or revisit of each archive row.

    page_id and refers_to are the numbers in names that `write_archives` gives, null for others;
    the payload's length and digest are those of the whole payload also for revisits. Records of
    other types are checked and left out. A malformed archive or record raises BadArchive and so
    fails its task. Null or empty content has no records.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in open_archive(content.as_py() or b""):
                    if headers["warc-type"] not in ("response", "revisit"):
                        read_payload(headers, block)
                        continue
                    if page_name(headers["warc-record-id"]):
                        size, digest = read_response(headers, block)
                    else:  # foreign: a revisit need not say how long its payload was
                        payload = read_payload(headers, block)
                        size, digest = (None, headers.get("warc-payload-digest", "").removeprefix("sha1:") or None) if headers["warc-type"] == "revisit" else (len(payload), payload_digest(payload))
                    refers = headers.get("warc-refers-to")
                    rows.append((_page(headers["warc-record-id"]), size, digest, headers["warc-type"], _page(refers) if refers else None))
                cols = list(zip(*rows)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select(content_col).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def page_name(record_id: str) -> re.Match | None:
    """A name that `write_archives` gives: the page's number, if it has one, then the mark."""
    return re.fullmatch(r"<urn:page:(-?[0-9]{1,19})?(:[0-9]+-[0-9]+)?>", record_id)


def _page(record_id: str) -> int | None:
    named = page_name(record_id)
    return int(named[1]) if named and named[1] else None


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives of `pages` to the shared folder, then read the records back from them."""
    return read_archives(cut(write_archives(pages, min_bytes)))

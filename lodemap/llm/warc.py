"""WARC archives with per-record Zstandard compression and a shared dictionary.

A dictionary is built from a bounded sample of the records.  Every archive file
begins with a skippable frame that embeds it, followed by one Zstandard frame
for each record, so a record can be read alone from its offset.  Payloads that
occur again are written as ``revisit`` records of the first (smallest id) one.

Each task writes one archive under a name of its own and reports it in the
manifest; files of lost or repeated attempts are in no manifest and so are never
read.  Null payloads count as empty; a null url gives no target URI.  Ids may be of
any type with a text form.  A row with a null id revisits the response of its payload;
if no row of a payload has an id, all are responses.  Rows that repeat both id and
payload of a response are responses too.  An empty table gives no archive.  Columns other than the three named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import file_system, new_path, sized, stored

#: The dictionary is built from so many records at most, of each so many characters.
SAMPLE_RECORDS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 16_384, 65_536
#: Magic number of the skippable frame that holds a dictionary (fixed value).
DICTIONARY_MAGIC = 0x184D2A5D
#: An archived payload is at most so long in one read.
CHUNK, STEP = 1 << 20, 1 << 12
DATE = "2024-01-01T00:00:00Z"


def build_dictionary(pages: DataFrame) -> bytes:
    """A Zstandard dictionary from a bounded sample of records (_html), spread by hash; b'' if there are too few to build one."""
    import zstandard

    rows = pages.select(F.substring("_html", 1, SAMPLE_CHARS).alias("_start"), F.sha1("_html").alias("_sha")).where("_html <> ''")
    # Hashes first: a task's share of a top list goes to the driver, so it must not hold pages.
    asked = rows.select("_sha").orderBy("_sha").limit(SAMPLE_RECORDS).collect()
    if not asked:
        return b""
    chosen = rows.where(F.col("_sha") <= asked[-1]["_sha"]).groupBy("_sha").agg(F.first("_start").alias("_start"))
    start = {r["_sha"]: r["_start"].encode() for r in chosen.collect()}
    sample = [start[r["_sha"]] for r in asked]
    if len(sample) < 16 or sum(map(len, sample)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, sample)) // 10), sample, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id) -> str:
    """A page's id as a record's; any text is allowed, and none too."""
    return "<urn:no-page>" if page_id is None else f"<urn:page:{urllib.parse.quote(str(page_id), safe='')}>"


def page_of(name: str | None) -> str | None:
    """The page's id, as text, of a record's."""
    return urllib.parse.unquote(name[len("<urn:page:") : -1]) if name and name.startswith("<urn:page:") else None


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC 1.1 record: a response, or a revisit if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{bare_digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head.append(f"WARC-Refers-To: {urn(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
) -> DataFrame:
    """Writes every row as a record and returns the manifest (file string, records long, bytes long).

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that
    with the smallest id is a response and the others revisit it.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html")
    ).withColumn("_sha", F.sha1(F.encode("_html", "UTF-8")))
    again = (
        rows.where(F.octet_length("_html") >= min_revisit_bytes)
        .groupBy("_sha")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    again = stored(again, "warc-repeats")
    rows = rows.join(sized(again, again.count()), "_sha", "left").select(
        "_id", "_url", "_html", F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("_refers")
    )
    words = build_dictionary(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        out, size, n = None, 0, 0
        made = zstandard.ZstdCompressionDict(words) if words else None
        press = zstandard.ZstdCompressor(level=3, dict_data=made)
        for batch in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs, where = file_system(folder)
                    fs.create_dir(where, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(f"{where}/{name}")
                    if words:
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words)
                frame = press.compress(record(page_id, url, html.encode(), refers))
                out.write(frame)
                size, n = size + len(frame), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())],
                ["file", "records", "bytes"],
            )

    return stored(rows.mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


def frames(stream, size: int = CHUNK) -> Iterator[bytes]:
    """Decompressed records of one archive, in order, a chunk of the file at a time."""
    import zstandard

    data = stream.read(8)
    made = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        made = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", data[4:])[0]))
        data = b""
    context = zstandard.ZstdDecompressor(dict_data=made)
    one, parts, at = context.decompressobj(), [], 0
    while True:
        if at == len(data):
            data, at = memoryview(stream.read(size)), 0
        if not data:
            if parts:
                raise ValueError("an archive ends inside a record")
            return
        piece = data[at : at + STEP]  # what is left of a piece is copied, so it is kept short
        parts.append(one.decompress(piece))
        at += len(piece)
        if one.eof:
            yield b"".join(parts)
            at -= len(one.unused_data)
            parts, one = [], context.decompressobj()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def read_archives(manifest: DataFrame, with_payload: bool = False, id_type: str = "long") -> DataFrame:
    """Reads the archives of a manifest back and checks every response against its digest.

    Returns (page_id, url, payload_bytes long, payload_digest, record_type, refers_to,
    and payload binary if ``with_payload``); ids are of ``id_type``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = file_system(file)
                with fs.open_input_stream(path) as stream:
                    got: list[tuple] = []
                    held = 0
                    for raw in frames(stream):
                        f, payload = parse(raw)
                        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if f["WARC-Type"] == "response" and bare_digest(payload) != digest:
                            raise ValueError(f"{file}: a payload differs from its digest")
                        refers = page_of(f.get("WARC-Refers-To"))
                        got.append((page_of(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), int(f["WARC-Payload-Length"]), digest, f["WARC-Type"], refers, payload if with_payload else b""))
                        held += len(payload) if with_payload else 100
                        if held > CHUNK:
                            yield as_batch(got)
                            got, held = [], 0
                    if got:
                        yield as_batch(got)

    def as_batch(got: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()][: 6 + with_payload]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + with_payload]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names)

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    files = max(1, manifest.count())
    out = manifest.select("file").repartition(files).mapInArrow(run, schema + (", payload binary" if with_payload else ""))
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})

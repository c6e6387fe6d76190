"""WARC archives with a shared Zstandard dictionary, one compressed frame per record.

An archive starts with a skippable frame that holds the dictionary; then every record is
a frame of its own, so a reader can start at any record once it has the dictionary.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import hot_join, least_hashed, saved, shared_folder

#: Magic number of the skippable frame that carries a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: An archive is closed once it holds so many bytes.
ARCHIVE_BYTES = 16 << 20
SAMPLE_RECORDS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 16 << 10, 64 << 10
LEVEL = 3
#: Date of records whose pages come without one.
DATE = "2024-01-01T00:00:00Z"


def classified(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, digest, size and refers_to (the response a revisit points at).

    The smallest id per digest is combined on the map side, so a payload that a third of all
    pages share costs one row per task; digests of many pages are broadcast, others meet
    their pages by hash.  Only digests and ids are shuffled for that, and payloads once.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    base = base.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    least = base.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    least = saved(least.filter("n > 1"), "digests")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = hot_join(base, least, ["digest"], "n", total, ["page_id", "url"])
    return out.withColumn("refers_to", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))).drop("first_id", "n")


def sampled_slices(pages: DataFrame, html: str = "html") -> list[str]:
    """Slices of at most SAMPLE_RECORDS different payloads.

    The sample is bounded whatever the table holds: payloads of least hash, copies counting
    once as in the archives, and of each at most SAMPLE_CHARS characters from a place that
    its hash sets.
    """
    place = F.pmod(F.shiftright(F.xxhash64(html), 8), F.greatest(F.length(html) - SAMPLE_CHARS + 1, F.lit(1)).cast("long")) + 1
    whole = pages.filter(F.length(html) > 0).select(F.xxhash64(html).alias("h"), F.substring(F.col(html), place.cast("int"), F.lit(SAMPLE_CHARS)).alias("t"))
    return [r.t for r in least_hashed(whole.groupBy("h").agg(F.first("t").alias("t")), SAMPLE_RECORDS, "h").collect()]


def train_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary from a bounded sample.  Where records are too few or too alike to train on,
    the slices themselves are the dictionary.  It only changes how small archives are, never
    what they hold.  Empty when no page has text.
    """
    import zstandard

    slices = sampled_slices(pages, html)
    texts = [_record("response", "https://example.com/", "0", hashlib.sha256(t.encode()).hexdigest(), len(t), None, t.encode()) for t in slices]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(texts)[-DICTIONARY_BYTES:]


def _urn(page: str | None) -> str:
    return "urn:page-unknown" if page is None else "urn:page:" + quote(page, safe="")


def _page(urn: str | None) -> str | None:
    name = (urn or "").strip("<>")
    return unquote(name.removeprefix("urn:page:")) if name.startswith("urn:page:") else None


def _block(head: list[str], body: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _record(kind: str, url: str | None, page: str | None, digest: str, size: int, refers: str | None, payload: bytes, date: str = DATE) -> bytes:
    """A response with its HTTP head and payload, or a revisit with the head alone."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{_urn(page)}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers is not None:
        head += [f"WARC-Refers-To: <{_urn(refers)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _block(head, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload)


def _information(name: str, date: str) -> bytes:
    body = b"software: quern\r\nformat: WARC File Format 1.1\r\n"
    return _block(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], body)


def _files(folder: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(records: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write records (see classified) as archives under folder; returns path, records, bytes.

    After the dictionary's frame an archive has a warcinfo record, which is not counted, and
    then the records, each a frame of its own.  An archive appears under its name only when whole: a lost or repeated task leaves at
    worst an unlisted file.  Readers take the listed ones.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        system, top = _files(folder)
        system.create_dir(top, recursive=True)
        options = {"level": LEVEL} | ({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {})
        squeeze = zstandard.ZstdCompressor(**options)
        lead = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary

        def close(parts: list[bytes]) -> pd.DataFrame:
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = b"".join([lead, squeeze.compress(_information(name, date)), *parts])
            with system.open_output_stream(f"{top}/{name}.open", compression=None) as f:
                f.write(data)
            system.move(f"{top}/{name}.open", f"{top}/{name}")
            return pd.DataFrame({"path": [f"{folder}/{name}"], "records": [len(parts)], "bytes": [len(data)]})

        parts, held = [], len(lead)
        for batch in batches:
            for page, url, payload, digest, size, refers in zip(*(batch[c] for c in columns), strict=True):
                frame = squeeze.compress(_record("response" if refers is None else "revisit", url, page, digest, int(size), refers, payload if refers is None else b"", date))
                parts.append(frame)
                held += len(frame)
                if held >= archive_bytes:
                    yield close(parts)
                    parts, held = [], len(lead)
        if parts:
            yield close(parts)

    columns = ("page_id", "url", "payload", "digest", "size", "refers_to")
    text = records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return text.select(*columns).mapInPandas(write, "path string, records long, bytes long")


def read_frames(data: bytes, step: int = 32 << 10) -> Iterator[bytes]:
    """The records of one archive; each frame is fed in steps until it ends."""
    import zstandard

    view, at, opener = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, n = struct.unpack_from("<II", view, at) if len(view) - at >= 8 else (0, 0)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_FRAME and n:
                opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + n])))
            at += 8 + n
            continue
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("archive ends within a record")
            parts.append(frame.decompress(view[at : at + step]))
            at += min(step, len(view) - at)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, v in fields.items()} | {"body": body[: int(fields["Content-Length"])]}


def read_archives(listing: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per response or revisit of the listed archives, digests recomputed from payloads."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                folder, _, name = path.rpartition("/")
                system, top = _files(folder)
                with system.open_input_stream(f"{top}/{name}", compression=None) as f:
                    data = f.read()
                rows = []
                for record in map(parse_record, read_frames(data)):
                    if record["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = record["body"].partition(b"\r\n\r\n")
                    digest, size = record["warc-payload-digest"].removeprefix("sha256:"), int(http.rpartition(b"Content-Length: ")[2])
                    if record["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or size != len(payload)):
                        raise ValueError(f"record {record['warc-record-id']} in {path} does not match its digest")
                    rows.append((_page(record["warc-record-id"]), size, digest, record["warc-type"], _page(record.get("warc-refers-to")), record.get("warc-target-uri")))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    found = listing.mapInPandas(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write pages to archives in folder (the shared one by default): (listing, records read back).

    Ids are numbers or text, and come back as they were.  Null html is an empty payload; null urls have no target line; a null page_id never leads
    nor revisits; rows that repeat an id are records of their own, and those that repeat the
    least id of a payload are all responses.  No pages: no archives.
    """
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    dictionary = train_dictionary(pages)
    listing = saved(write_archives(classified(pages), folder, dictionary), "archives")
    spread = listing.repartition(max(1, min(4096, listing.count())))
    return listing, read_archives(spread, pages.schema["page_id"].dataType.simpleString())

"""WARC archives: written and read by tasks in a stream, as a table of payload chunks.

The writer gives every row one record (response, or revisit of an equal payload) in a gzip member of its own and streams large
payloads into it. The reader inflates archives piece by piece and yields a row per record and chunk: record id, chunk number,
bytes, and the digest of the payload so far, so that the last chunk's digest is the record's and no record is ever whole in memory.
Files are named by task attempt; only those that a finished task lists in the manifest table are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtide.llm.common import stored, work_dir

#: A header holds its row's URL, so it may be long; beyond MAX_HEADER a file is taken for damaged.
CHUNK, MIN_REVISIT, LEVEL, MAX_HEADER = 1 << 18, 1000, 1, 1 << 28
MANIFEST = "file string, records long"
CHUNKS = "record_id string, page_id long, record_type string, target_uri string, refers_to long, payload_digest string, chunk_no int, chunk_bytes long, payload_so_far long, digest_so_far string"


def _open(path: str, write: bool):  # noqa: ANN202
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if write:
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(inner, compression=None)
    return store.open_input_stream(inner, compression=None)


def _clean(value: object) -> str:
    return " ".join(str(value).split()) if value is not None else ""


def _record(page: int | None, url: str | None, digest: str, kind: str, refers: int | None, length: int, name: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:x-page:{name}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": _clean(url),
            "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "text/html", "Content-Length": str(length)}
    if page is not None:
        head["X-Page-Id"] = str(page)
    if kind == "revisit":
        head |= {"WARC-Refers-To": f"<urn:x-page:{refers}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode()


def digests(pages: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return F.sha1(body), F.octet_length(body).cast("long")


def revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that repeat the payload of the row with the largest id. Works on ids and digests alone."""
    big = pages.where(F.col("bytes") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    last = big.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("ids")).where("ids > 1 and refers_to is not null")
    again = big.join(last, "digest").where("page_id is null or page_id < refers_to")
    return again.select("page_id", "digest", "refers_to")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """Write one record per row into archives under ``folder``; returns the manifest (file, records).

    Null payloads are empty. Rows whose payload of ``least`` bytes or more occurs under a larger id become revisits of the largest; rows that repeat
    that id are responses too. A null id revisits like others and is never revisited. Other columns are ignored. Nothing is written for no rows.
    """
    digest, size = digests(pages, id_col, text_col)
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("html"),
                     digest.alias("digest"), size.alias("bytes"))
    again = stored(revisits(p.select("page_id", "digest", "bytes"), least), "revisits").select(
        F.col("page_id").alias("again"), F.col("digest").alias("again_digest"), "refers_to", F.lit(True).alias("is_again"))
    typed = p.join(again, p["page_id"].eqNullSafe(again["again"]) & (p["digest"] == again["again_digest"]), "left")
    typed = typed.select("page_id", "url", "html", "digest", "refers_to", F.coalesce("is_again", F.lit(False)).alias("is_again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, out, n = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for page, url, html, digest, refers, again in zip(*b.columns, strict=True):
                out = out or _open(file, True)
                body = memoryview(b"" if again.as_py() else html.as_buffer())
                name = page.as_py() if page.is_valid else f"none-{uuid.uuid4().hex}"
                z = zlib.compressobj(LEVEL, wbits=31)
                out.write(z.compress(_record(page.as_py(), url.as_py(), digest.as_py(), "revisit" if again.as_py() else "response", refers.as_py(), len(body), name)))
                for at in range(0, len(body), CHUNK):
                    out.write(z.compress(body[at:at + CHUNK]))
                out.write(z.compress(b"\r\n\r\n") + z.flush())
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [file], "records": pa.array([n], pa.int64())})

    return stored(typed.mapInArrow(run, MANIFEST), "manifest")


class _Archive:
    """Bytes of a gzip archive of many members, inflated as they are asked for."""

    def __init__(self, stream):  # noqa: ANN001
        self.stream, self.z, self.raw, self.buffer = stream, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            self.raw = self.raw or self.stream.read(CHUNK)
            if not self.raw:
                return False
            got = self.z.decompress(self.raw, CHUNK)
            self.raw = self.z.unconsumed_tail
            if got:
                self.buffer += got
                return True

    def header(self) -> bytes | None:
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if len(self.buffer) > MAX_HEADER:
                raise ValueError("no record header where one should be")
            if not self._more():
                if self.buffer:
                    raise ValueError("archive ends in a record header")
                return None
        head = bytes(self.buffer[:at])
        del self.buffer[:at + 4]
        return head

    def take(self, most: int) -> bytes:
        if not self.buffer and not self._more():
            raise ValueError("archive ends in a record")
        got = bytes(self.buffer[:most])
        del self.buffer[:most]
        return got


def records(stream) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:  # noqa: ANN001
    """(header fields, payload chunks) of an archive; a record's chunks are read before the next record is asked for."""
    a = _Archive(stream)
    while (head := a.header()) is not None:
        first, *lines = head.decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)

        def payload(left: int) -> Iterator[bytes]:
            while left:
                got = a.take(min(CHUNK, left))
                left -= len(got)
                yield got
            end = b""
            while len(end) < 4:
                end += a.take(4 - len(end))
            if end != b"\r\n\r\n":
                raise ValueError("record without its end")

        yield fields, payload(int(fields["Content-Length"]))


def read(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in the manifest: a row per record and chunk, an empty payload has one chunk of no bytes.

    ``data`` holds the chunk's bytes if asked for. A payload's digest that differs from the header's is an error, not a row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CHUNKS.split(", ")] + ["data"] * with_data
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_data
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return made

        for b in batches:
            for file in b.column(0).to_pylist():
                with _open(file, False) as stream:
                    for f, chunks in records(stream):
                        page, refers, digest = f.get("X-Page-Id"), f.get("WARC-Refers-To"), f["WARC-Payload-Digest"].removeprefix("sha1:")
                        one = (f["WARC-Record-ID"], int(page) if page else None, f["WARC-Type"], f.get("WARC-Target-URI"),
                               int(refers.removeprefix("<urn:x-page:").rstrip(">")) if refers else None, digest)
                        sha, k, n = hashlib.sha1(), 0, 0
                        for data in chunks:
                            sha.update(data)
                            n += len(data)
                            rows.append((*one, k, len(data), n, sha.hexdigest(), *[data] * with_data))
                            k += 1
                            if len(rows) * (CHUNK if with_data else 400) >= 1 << 23:
                                yield batch()
                        if not k:
                            rows.append((*one, 0, 0, 0, sha.hexdigest(), *[b""] * with_data))
                        if f["WARC-Type"] == "response" and sha.hexdigest() != digest:
                            raise ValueError(f"payload of {one[0]} differs from its digest")
        if rows:
            yield batch()

    one_each = manifest.select("file").repartition(max(1, manifest.count()), "file")  # a task for each archive, not merged
    return one_each.mapInArrow(run, CHUNKS + ", data binary" * with_data)


def record_table(chunks: DataFrame) -> DataFrame:
    """One row per record from its chunks: the last chunk has the payload's size and digest. Revisits take both from the record they refer to."""
    last = F.max(F.struct("chunk_no", "payload_so_far", "digest_so_far"))
    r = chunks.groupBy("record_id", "page_id", "record_type", "target_uri", "refers_to", "payload_digest").agg(last.alias("last"), F.count_if(F.col("chunk_no") == 0).alias("times"))
    r = r.select("page_id", "record_type", "target_uri", "refers_to", "payload_digest", F.col("last.payload_so_far").alias("size"), "times")
    sizes = r.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("size").alias("whole"))
    r = r.join(sizes, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.coalesce("whole", "size"))
    r = r.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))  # rows repeated in the table are repeated records
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """Write all rows to archives in the shared folder, read them back; a row per record."""
    manifest = write(pages, work_dir(pages.sparkSession, "warc"), id_col, url_col, text_col, least)
    return record_table(stored(read(manifest, with_data=False), "chunks"))

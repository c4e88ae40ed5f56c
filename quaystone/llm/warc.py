"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of a few records, followed by a seek table
in a skippable frame: the compressed and the uncompressed size of every frame, their number and a
magic number, so a reader finds any frame from the end of the file. The index that comes with the
bundles maps each record identifier to its frame and its place in it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quaystone.llm.common import bound_arrow
from quaystone.plans.storage import materialise, new_path

#: Fixed values of the seekable format: magic numbers of a skippable frame and of the seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame and in a bundle, about.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20


class BundleWriter:
    """Writes one bundle as a stream; holds one frame at a time and 8 bytes for each finished one."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frame, self.used, self.table = [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self.used and self.used + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.table), self.used
        self.frame.append(record)
        self.used += len(record)
        return place

    def flush(self) -> None:
        if self.frame:
            packed = self.packer.compress(b"".join(self.frame))
            self.out.write(packed)
            self.table.append((len(packed), self.used))
            self.frame, self.used = [], 0

    def close(self) -> None:
        self.flush()
        rows = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(rows) + len(footer)) + rows + footer)


class BundleReader:
    """Reads single frames of a seekable bundle."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        frames, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("the file has no seek table")
        file.seek(size - 9 - 8 * frames)
        rows, at, self.at = file.read(8 * frames), 0, []
        for i in range(frames):
            packed, plain = struct.unpack_from("<II", rows, 8 * i)
            self.at.append((at, packed, plain))
            at += packed
        self.opener = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.at[i]
        self.file.seek(at)
        return self.opener.decompress(self.file.read(packed), max_output_size=plain)


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One WARC 1.1 record. A revisit has no payload, but names what it repeats."""
    kind = "response" if refers_to is None else "revisit"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"urn:page:{page_id}:{url}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Page-ID: {page_id}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/octet-stream",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the record that begins at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record begins here")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    return headers, data[end + 4 : end + 4 + n]


def first_of_equals(pages: DataFrame, least: int, id_col: str, html_col: str, salts: int = 16) -> DataFrame:
    """Adds sha1_ and refers_to_: the smallest id of equal payloads of at least ``least`` bytes, null for that one itself.

    Only payloads that occur again are joined; a payload's rows are spread over ``salts`` keys, so
    one that makes up much of the table does not land in one task.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.withColumns({"sha1_": F.sha1(payload.cast("binary")), "bytes_": F.octet_length(payload).cast("long")})
    firsts = rows.where(F.col("bytes_") >= least).groupBy("sha1_").agg(F.min(id_col).alias("first_"), F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    firsts = materialise(firsts.select("sha1_", "first_"), "firsts").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    joined = salted.join(firsts, ["sha1_", "salt_"], "left")
    return joined.withColumn("refers_to_", F.when((F.col("bytes_") >= least) & (F.col("first_") < F.col(id_col)), F.col("first_")))


def write(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the bundles of ``pages`` into ``folder`` (a URI that all executors share); returns their index.

    The index has bundle, frame, at (offset in the frame) and the record's id. A task writes to a
    name of its own attempt and moves the file when it is whole, so attempts that are lost leave no
    bundle behind that the index names. A null html is an empty payload. Rows with a null id are
    responses and refer to nothing; among repeated rows with the smallest id each is a response.
    """
    bound_arrow(pages.sparkSession)
    id_kind = pages.schema[id_col].dataType.simpleString()
    ready = first_of_equals(pages.select(F.col(id_col).alias("id_"), F.col(url_col).cast("string").alias("url_"), F.col(html_col).cast("string").alias("html_")), least, "id_", "html_")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        own = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        made, writer, out, written = 0, None, None, 0

        def finish() -> None:
            writer.close()
            out.close()
            store.move(f"{own}-{made:04d}.open", f"{own}-{made:04d}.warc.zst")

        for pdf in batches:
            rows = []
            for page, url, html, sha1, first in zip(pdf["id_"].tolist(), pdf["url_"].tolist(), pdf["html_"].tolist(), pdf["sha1_"].tolist(), pdf["refers_to_"].tolist()):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{own}-{made:04d}.open")
                    writer, written = BundleWriter(out, frame_bytes), 0
                data = record(page, url, (html or "").encode(), base64.b32encode(bytes.fromhex(sha1)).decode(), first)
                frame, at = writer.add(data)
                rows.append((page, f"{own.rsplit('/', 1)[1]}-{made:04d}.warc.zst", frame, at))
                written += len(data)
                if written >= bundle_bytes:
                    finish()
                    writer, made = None, made + 1
            yield pd.DataFrame(rows, columns=["id_", "bundle", "frame", "at"])
        if writer is not None:
            finish()

    # Ids travel as text, for pandas would make those with nulls among them inexact.
    sent = ready.select(F.col("id_").cast("string"), "url_", "html_", "sha1_", F.col("refers_to_").cast("string"))
    kept = sent.mapInPandas(run, "id_ string, bundle string, frame int, at long")
    return materialise(kept.select(F.col("id_").cast(id_kind).alias(id_col), "bundle", "frame", "at"), "warc-index")


def read(index: DataFrame, folder: str, id_col: str = "page_id") -> DataFrame:
    """(id, payload_bytes long, payload_digest, record_type, refers_to) of every record of the index, read from the bundles by frame.

    The payload digest is taken anew over each response's payload, and must be the one it states.
    """
    id_kind = index.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pafs.FileSystem.from_uri(folder)
        name = reader = file = data = None
        loaded = -1
        for pdf in batches:
            rows = []
            for page, bundle, frame, at in zip(pdf["id_"].tolist(), pdf["bundle"].tolist(), pdf["frame"].tolist(), pdf["at"].tolist()):
                if bundle != name:
                    if file is not None:
                        file.close()
                    file = store.open_input_file(f"{root}/{bundle}")
                    name, reader, loaded = bundle, BundleReader(file, file.size()), -1
                if frame != loaded:
                    data, loaded = reader.frame(frame), frame
                headers, block = parse(data, at)
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response":
                    own = base64.b32encode(hashlib.sha1(block).digest()).decode()
                    if own != digest:
                        raise ValueError(f"record {headers['WARC-Page-ID']} is damaged")
                refers = headers.get("WARC-Refers-To-Page-ID")
                rows.append((None if page is None else headers["WARC-Page-ID"], int(headers["WARC-Payload-Length"]), digest, headers["WARC-Type"], refers))
            yield pd.DataFrame(rows, columns=["id_", "payload_bytes", "payload_digest", "record_type", "refers_to"], dtype=object)
        if file is not None:
            file.close()

    # Rows of a frame stay together and in order, so each frame is read once.
    placed = index.select(F.col(id_col).cast("string").alias("id_"), "bundle", "frame", "at").repartition("bundle", F.floor(F.col("frame") / 8)).sortWithinPartitions("bundle", "frame", "at")
    out = placed.mapInPandas(run, "id_ string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.select(F.col("id_").cast(id_kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_kind).alias("refers_to"))


def archive(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to bundles in the shared folder and read every record back."""
    folder = new_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    return read(write(pages, folder, least, id_col, url_col, html_col), folder, id_col)

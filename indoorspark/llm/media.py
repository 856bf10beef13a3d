"""Media columns (operator 6): content-addressed payloads in tar shards, read back by ranges."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from indoorspark.llm.common import new_path, stored, table
from indoorspark.llm.words import text_groups

#: A payload is padded to a multiple of this: a row of 64 pixels of three 8-bit samples.
UNIT = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of the signature and the first chunk, which hold width, height, depth and colour type.
HEADER = 33
SHARD_BYTES = 64 << 20
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
META = "width int, height int, depth int, colour int"
OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """A PNG whose 8-bit RGB samples are the payload's bytes, 64 pixels a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int, int]:
    """width, height, bit depth and colour type from the first HEADER bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not the header of a PNG")
    return struct.unpack(">IIBB", first[16:26])


def decode(media: bytes) -> bytes:
    width, height, _, _ = header(media)
    at, body = 8, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            body.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 3 * width + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean of the samples and the share of the four most frequent ones, by channel."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, 3)
    top = [np.sort(np.bincount(a[:, i], minlength=256))[-4:].sum() / len(a) for i in range(3)]
    return " ".join(f"{x:.4f}" for x in [*a.mean(axis=0), *top])


class Shard:
    """A tar file that is written under another name and moved when whole, so that a lost task leaves no half shard."""

    def __init__(self, folder: str):
        self.fs, path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = f"{path}/{uuid.uuid4().hex}.tar"
        self.out, self.at, self.held = self.fs.open_output_stream(self.name + ".part"), 0, {}

    def add(self, digest: str, media: bytes) -> tuple[int, int]:
        """(offset, length) of the media in the shard; the same digest is stored once."""
        if digest not in self.held:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + media + b"\0" * (-len(media) % 512))
            self.held[digest] = (self.at + len(head), len(media))
            self.at += len(head) + len(media) + -len(media) % 512
        return self.held[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()
        self.fs.move(self.name + ".part", self.name)


def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """Index rows (doc_id, n_bytes, digest, shard, offset, length); the payloads stand in tar shards in `folder`.

    The folder is a URI that pyarrow can open and all executors share. Null or empty text: one unit of
    spaces. Equal texts share their bytes inside a shard. Texts of any length are one payload. Repeated rows give
    repeated rows; other columns are ignored; an empty table gives no rows. The index is a written table, so that
    its rows always name shards that are whole.
    """

    def index(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = zip(zip(*rows, strict=True), kinds, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=[x.split()[0] for x in INDEX.split(", ")])

    def run(batches):
        shard, rows = None, []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, text in ((ids[at + i], t) for at, texts in text_groups(batch.column(1)) for i, t in enumerate(texts)):
                shard = shard or Shard(folder)
                n, payload = padded(text)
                digest = hashlib.sha256(payload).hexdigest()
                place = shard.held.get(digest) or shard.add(digest, encode(payload))
                rows.append((doc, n, digest, shard.name, *place))
                if shard.at >= SHARD_BYTES or len(rows) >= 100_000:
                    shard.close()
                    yield index(rows)
                    shard, rows = None, []
        if shard:
            shard.close()
            yield index(rows)

    return stored(docs.select("doc_id", "text").mapInArrow(run, INDEX), "media-index")


class Reader:
    """Range reads from shards, one file open at a time."""

    def __init__(self, folder: str):
        self.fs, _ = fs.FileSystem.from_uri(folder)
        self.name = self.file = None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.name, self.file = name, self.fs.open_input_file(name)
        return self.file.read_at(length, offset)


def add_metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height, depth and colour, from reads of each header alone."""

    def run(batches):
        reader = Reader(folder)
        for b in batches:
            got = [header(reader.read(*x, HEADER)) for x in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([g[i] for g in got], pa.int32()) for i in range(4))], names=[*b.schema.names, "width", "height", "depth", "colour"])

    return index.mapInArrow(run, f"{INDEX}, {META}")


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Digests and features of every row's stored bytes, decoded from its range of its shard."""

    def run(batches: Iterator[pa.RecordBatch]):
        reader = Reader(folder)
        for b in batches:
            rows, last = [], (None, None)
            for doc, n, digest, shard, offset, length, width, height in zip(*(c.to_pylist() for c in b.columns[:8]), strict=True):
                if last[0] != (shard, offset):
                    media = reader.read(shard, offset, length)
                    payload = decode(media)
                    got = hashlib.sha256(payload).hexdigest()
                    if got != digest or width * height * 3 != len(payload):
                        raise ValueError(f"{shard} at {offset}: not what was stored")
                    last = ((shard, offset), (len(payload), got, zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
                rows.append((doc, n, *last[1]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return index.mapInArrow(run, OUT)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts into shards, headers into columns, stored bytes back into digests. Repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows."""
    folder = new_path(spark, "media-shards")
    return read_back(add_metadata(write_shards(table(spark, sf_dir, "documents"), folder), folder), folder)

"""Media columns: text payloads kept as motion-JPEG in AVI, read back, cut into shots and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mjpeg
from .common import bounded_batches, in_parts, table, texts_of

CLIP = "struct<clip:int,start_ms:double,end_ms:double,frames:int,mean:double>"
SCHEMA = f"doc_id bigint,n_bytes bigint,payload_bytes bigint,payload_sha256 string,tail_crc32 bigint,media_bytes bigint,media_sha256 string,feature string,clips array<{CLIP}>"


def store(payload: bytes) -> bytes:
    """AVI bytes of a payload whose length is a positive multiple of 64: rows of 64 samples, at most 64 to a frame.
    All frames share their height; the last is filled with zero rows, whose number its first marker segment tells."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, mjpeg.WIDTH)
    height = min(mjpeg.MOST_ROWS, len(rows))
    fill = -len(rows) % height
    frames = mjpeg.encode_frames(np.concatenate([rows, np.zeros((fill, mjpeg.WIDTH), np.uint8)]).reshape(-1, height, mjpeg.WIDTH))
    if fill:
        note = b"fill=%d" % fill
        frames[-1] = frames[-1][:2] + bytes([0xFF, mjpeg.COM]) + (len(note) + 2).to_bytes(2, "big") + note + frames[-1][2:]
    return mjpeg.write_avi(frames, height)


def load(media: bytes) -> tuple[list[np.ndarray], float]:
    """Decoded frames without their fill rows, and a frame's milliseconds."""
    coded, ms = mjpeg.read_avi(media)
    frames = [mjpeg.decode_frame(f) for f in coded]
    if coded and coded[-1][2:4] == bytes([0xFF, mjpeg.COM]):
        note = coded[-1][6 : 4 + int.from_bytes(coded[-1][4:6], "big")]
        if note.startswith(b"fill="):
            frames[-1] = frames[-1][: len(frames[-1]) - int(note[5:])]
    return frames, ms


def clips(media: bytes) -> list[dict]:
    """Timed clip rows of an AVI file."""
    frames, ms = load(media)
    return _clips(frames, ms)


def _clips(frames: list[np.ndarray], ms: float) -> list[dict]:
    return [
        {"clip": k, "start_ms": a * ms, "end_ms": b * ms, "frames": b - a, "mean": round(float(np.mean([f.mean() for f in frames[a:b]])), 6)}
        for k, (a, b) in enumerate(mjpeg.shots(frames))
    ]


def media_rows(docs: DataFrame) -> DataFrame:
    """A row per document: digests of payload and media, a feature string, and the clips.

    Null and empty texts give one row of zero samples; repeated rows stay; a null doc_id stays null. Columns besides
    doc_id and text are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            out = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                media = store(raw + b"\0" * (64 - len(raw) if not raw else -len(raw) % 64))
                frames, ms = load(media)
                back = b"".join(f.tobytes() for f in frames)
                timed = _clips(frames, ms)
                hist = np.bincount(np.frombuffer(back, np.uint8) >> 4, minlength=16) * 255 // len(back)
                feature = f"{len(frames)}f:" + ".".join(str(c["frames"]) for c in timed) + ":" + bytes(hist.astype(np.uint8)).hex()
                out.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, timed))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)

    return bounded_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, SCHEMA)


_CLIP_TYPE = pa.list_(pa.struct([("clip", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("frames", pa.int32()), ("mean", pa.float64())]))
_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
_TYPES = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _CLIP_TYPE]


def clip_rows(media: DataFrame) -> DataFrame:
    """(doc_id, clip, start_ms, end_ms, frames, mean): the timed clips of media_rows(), one row each."""
    return media.select("doc_id", F.explode_outer("clips").alias("c")).select("doc_id", "c.*")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media_rows(table(spark, sf_dir, "documents"))
    timed = F.transform("clips", lambda c: F.concat_ws(":", c["start_ms"], c["end_ms"], c["frames"], c["mean"]))
    return rows.withColumn("clips", F.concat_ws(",", timed))

"""Media columns (operator 2): texts as WAV files in a binary column, spectral-peak pairs as time-coded arrays.

A payload is stored as the 8-bit mono samples of a WAV file.  The stored file is read again by the
wave module; a short-time Fourier transform gives frames, every frame its strongest bin in each of
two bands, and a low peak is paired with the high peaks of the next frames.  A pair is one number:
frame, low bin, high bin, distance in frames.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNIT = 576
RATE = 8000
FRAME = 576
HOP = 288
#: Frames and hops of files that have REACH frames or fewer.  Their transforms are filled up to FRAME, so bins mean the same; half a
#: frame of the padding stands before them, and a peak is paired within its own frame too, so that a few bytes have a pair.
SHORT_FRAME, SHORT_HOP = 192, 48
#: Bins of the two bands, and how many later frames a low peak is paired with.
LOW, HIGH, REACH = (4, 96), (96, 288), 3
#: Samples transformed at a time.
SLAB = 1 << 21

FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("feature", pa.string())])
_WINDOW = {n: np.hanning(n).astype(np.float32) for n in (FRAME, SHORT_FRAME)}


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or (UNIT if not text else 0))


def is_short(samples: np.ndarray) -> bool:
    return len(samples) < FRAME + REACH * HOP


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strongest bin of each frame in either band; -1 where a band is silent."""
    size, hop = FRAME, HOP
    if is_short(samples):
        size, hop = SHORT_FRAME, SHORT_HOP
        samples = np.concatenate([np.full(size // 2, 255, np.uint8), samples])
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    found = [[], []]
    for at in range(0, len(frames), SLAB // FRAME):
        x = frames[at : at + SLAB // FRAME].astype(np.float32)
        x -= x.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(x * _WINDOW[size], FRAME, axis=1))
        for band, (a, b) in zip(found, (LOW, HIGH), strict=True):
            top = power[:, a:b].argmax(axis=1)
            loud = np.take_along_axis(power[:, a:b], top[:, None], axis=1)[:, 0] > 1.0
            band.append(np.where(loud, top + a, -1))
    return np.concatenate(found[0]), np.concatenate(found[1])


def pairs(low: np.ndarray, high: np.ndarray, nearest: int = 1) -> np.ndarray:
    """Time-coded pairs in the order of their frames: frame << 20 | low bin << 11 | high bin << 2 | distance."""
    t = np.arange(len(low), dtype=np.int64)
    out = [(t[: len(t) - d] << 20 | low[: len(t) - d] << 11 | high[d:] << 2 | d)[(low[: len(t) - d] >= 0) & (high[d:] >= 0)] for d in range(nearest, REACH + 1) if len(t) > d]
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            payload = from_wav(media)
            samples = np.frombuffer(payload, np.uint8)
            code = pairs(*peaks(samples), 0 if is_short(samples) else 1)
            digest = hashlib.sha256(code.astype("<i8").tobytes()).hexdigest()
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), code, f"{len(code)}:{digest}"))
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FEATURES, strict=True)], schema=FEATURES)


def store(docs: DataFrame) -> DataFrame:
    """The written table doc_id, n_bytes (of the text), media (a WAV file).  Null and empty texts are one unit of 255s."""
    common.ship(docs.sparkSession)
    return common.write_table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary"), "media")


def fingerprint(media: DataFrame) -> DataFrame:
    """One row per stored file, read back: sizes, digests, pairs (array of time-coded numbers) and their digest.

    Equal files give equal features; short files are cut into shorter frames, and a silent one has no pairs.  Repeated
    rows and null doc_ids give a row each; an empty table gives none."""
    return media.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pairs array<long>, feature string")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(store(common.documents(spark, sf_dir)))

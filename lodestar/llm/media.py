"""Media columns: texts as 8-bit WAV samples, read back by the wave module and fingerprinted.

The fingerprint follows the known landmark scheme: a short-time Fourier transform, the strongest bins of each frame,
and pairs of peaks (two frequencies and their distance in frames), each stored with the frame it begins at.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames overlap by half, and the window is nowhere 0, so every sample has weight in some frame.
FRAME, HOP = 512, 256
RATE = 8000
#: Peaks kept per frame, and frames ahead in which an anchor is paired.
PEAKS, FAN = 2, 3
#: A weaker peak is no more than a rounding error of the transform.
FLOOR = 0.05
#: Frames transformed at once: memory stays the same however long a sample is.
CHUNK = 2048
BLOCK = 64
_WINDOW = np.hanning(FRAME + 2)[1:-1].astype(np.float32)
FEATURES = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "fingerprint_times array<int>, fingerprint_hashes array<int>"
)


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """(frames, PEAKS) strongest local maxima, ties to the lower bin, 0 for none; the last frame is filled with silence."""
    frames = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    found = np.zeros((frames, PEAKS), np.int32)
    for at in range(0, frames, CHUNK):
        some = min(CHUNK, frames - at)
        part = np.full((some - 1) * HOP + FRAME, 128, np.uint8)
        taken = samples[at * HOP : at * HOP + len(part)]
        part[: len(taken)] = taken
        x = (np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP].astype(np.float32) - 128) * _WINDOW
        power = np.abs(np.fft.rfft(x, axis=1)).astype(np.float32)[:, 1:]
        inner = (power[:, 1:-1] >= power[:, :-2]) & (power[:, 1:-1] > power[:, 2:]) & (power[:, 1:-1] >= FLOOR)
        level = np.where(inner, power[:, 1:-1], -1)
        for k in range(PEAKS):
            top = level.argmax(axis=1)
            found[at : at + some, k] = np.where(level[np.arange(some), top] > 0, top + 2, 0)
            level[np.arange(some), top] = -1
    return found


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and hashes of peak pairs, in order of time: a frame's two peaks, and its first with those of the
    next FAN frames. Silent frames have no pairs.
    """
    top = peaks(samples)
    times, hashes = [np.flatnonzero(top[:, 0])], [(top[:, 0] << 16) | (top[:, 1] << 4)]
    hashes[0] = hashes[0][times[0]]
    for gap in range(1, FAN + 1):
        both = np.flatnonzero((top[:-gap, 0] > 0) & (top[gap:, 0] > 0)) if len(top) > gap else np.zeros(0, np.int64)
        times.append(both)
        hashes.append((top[both, 0] << 16) | (top[both + gap, 0] << 4) | gap)
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.argsort(t, kind="stable")
    return t[order].astype(np.int32), h[order].astype(np.int32)


def encoded(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices with ``n_bytes`` and ``media`` (WAV bytes) instead of ``text``; null is the empty text."""
    names = [c for c in batch.schema.names if c != text]
    for part in sliced(batch, text):
        data = [b"" if v is None else v for v in part.column(text).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(map(len, data), pa.int64()), pa.array([to_wav(padded(d)) for d in data], pa.binary())], [*names, "n_bytes", "media"])


_ANALYSED = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("fingerprint_times", pa.list_(pa.int32())), ("fingerprint_hashes", pa.list_(pa.int32()))])


def analysed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What the stored samples of ``media`` say when they are read back, instead of the column."""
    kept = [c for c in batch.schema.names if c not in ("media", "n_bytes")]
    rows = []
    for n, stored in zip(batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
        data = stored.as_py()
        payload = from_wav(data)
        times, hashes = fingerprint(np.frombuffer(payload, np.uint8))
        rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), times, hashes))
    columns = zip(*rows, strict=True) if rows else [[]] * len(_ANALYSED)
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(list(c), f.type) for c, f in zip(columns, _ANALYSED, strict=True))], [*kept, *_ANALYSED.names])


def encode_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the media column ``media`` (WAV bytes) and ``n_bytes``; null is the empty text."""
    out = docs.select(*[c for c in docs.columns if c != text], F.col(text).cast("string").alias(text))
    schema = out.drop(text).selectExpr("*", "0L AS n_bytes", "CAST(NULL AS binary) AS media").schema
    return out.mapInArrow(lambda batches: (part for batch in batches for part in encoded(batch, text)), schema)


def sliced(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices with about ``most`` bytes in ``column``; a row stays whole."""
    if not batch.num_rows:
        return
    rows = max(1, int(batch.num_rows * most / max(1, batch.column(column).nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def analyse_media(media: DataFrame) -> DataFrame:
    """Reads the stored samples of ``media`` back and adds digests and the time-coded fingerprint arrays."""
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.drop("media", "n_bytes").schema)
    return media.mapInArrow(lambda batches: map(analysed, batches), f"{plain}, {FEATURES}")


def media_features(docs: DataFrame) -> DataFrame:
    """A row per document; ``feature`` is the fingerprint as ``time:hash`` pairs in order of time.

    Narrow: no shuffle, and equal texts give equal values wherever they are. A null text is an empty one; a text whose
    samples are silent has an empty feature. Repeated rows are rows of their own, an empty table gives none, and other
    columns are ignored.
    """
    # Stored and read back in one worker: media columns need not pass through the JVM.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    doc_id = texts.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(lambda batches: (analysed(part) for batch in batches for part in encoded(batch, "text")), f"doc_id {doc_id}, {FEATURES}")
    pairs = F.transform(F.arrays_zip("fingerprint_times", "fingerprint_hashes"), lambda p: F.concat(p["fingerprint_times"].cast("string"), F.lit(":"), F.lower(F.hex(p["fingerprint_hashes"]))))
    return found.withColumn("feature", F.concat_ws(",", pairs)).drop("fingerprint_times", "fingerprint_hashes")

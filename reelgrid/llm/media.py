"""Audio columns: WAV bytes, short-time Fourier transforms and spectral-peak pair fingerprints.

A column of WAV files (any mono 8-bit PCM) is read by the wave module. Frames of FRAME samples with half a frame's
overlap are taken about their mean, windowed and transformed; a frame's PEAKS strongest bins (by magnitude, the lower bin among equals) that
rise above the frame's mean are its peaks. Each peak is paired with those of the FAN next frames; a pair is one long:
the anchor's frame (32 bits), its bin (8), the other's bin (8) and the frames between (8). So the fingerprints of a clip are an
array in order of time, and equal clips have equal arrays. Frames are taken in chunks, so memory doesn't grow with a clip.

Null texts are empty; an empty text's payload is one block of PAD bytes. Repeated rows give equal values.
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

from reelgrid.llm.common import ROWS

BLOCK, PAD = 192, b" "
RATE, FRAME, PEAKS, FAN = 8000, 128, 2, 3
CHUNK = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(text: bytes) -> bytes:
    """The text and as many PAD bytes as make it a positive multiple of BLOCK."""
    return text + PAD * (max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    """The samples of a mono 8-bit WAV."""
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("only mono 8-bit PCM")
        return w.readframes(w.getnframes())


def peaks_of(samples: np.ndarray) -> np.ndarray:
    """The bins of each frame's peaks, -1 where it has fewer; silence follows what doesn't fill the last frame."""
    short = FRAME - len(samples) if len(samples) < FRAME else (FRAME - len(samples)) % (FRAME // 2)
    if short:
        samples = np.concatenate((samples, np.full(short, 128, np.uint8)))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[:: FRAME // 2]
    out = []
    for i in range(0, len(frames), CHUNK):
        x = frames[i : i + CHUNK].astype(np.float32)
        x = (x - x.mean(1, keepdims=True)) * _WINDOW
        size = np.abs(np.fft.rfft(x, axis=1))[:, 1:].astype(np.float32).round(3)
        top = np.empty((len(size), PEAKS), np.int64)
        mean = size.mean(1)
        for k in range(PEAKS):
            best = size.argmax(1)
            height = size[np.arange(len(size)), best]
            top[:, k] = np.where(height > mean, best + 1, -1)
            size[np.arange(len(size)), best] = -1
        out.append(top)
    return np.concatenate(out)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Peak pairs as longs, in order of time."""
    peaks = peaks_of(samples)
    n, found = len(peaks), []
    for gap in range(1, min(FAN, n - 1) + 1):
        for a in range(PEAKS):
            for b in range(PEAKS):
                one, two = peaks[: n - gap, a], peaks[gap:, b]
                ok = np.flatnonzero((one >= 0) & (two >= 0))
                found.append((ok << 24) | (one[ok] << 16) | (two[ok] << 8) | gap)
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def with_wav(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a binary column ``media``: each whole text's payload as a WAV, in place of a column of that name."""

    @F.arrow_udf("binary")
    def stored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([to_wav(padded(t or b"")) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())

    return docs.withColumn("media", stored(F.col(text)))


def with_fingerprints(clips: DataFrame, media: str = "media") -> DataFrame:
    """clips with an array column ``landmarks`` of time-coded peak pairs, in place of one of that name."""

    @F.arrow_udf("array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in batches:
            yield pa.array([fingerprint(np.frombuffer(from_wav(m), np.uint8)) if m is not None else None for m in some.to_pylist()], pa.list_(pa.int64()))

    return clips.withColumn("landmarks", of(F.col(media)))


def with_clips(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``media`` and its ``landmarks``: the two above in one Python worker, by small slices of rows; columns of these names are replaced."""

    @F.arrow_udf("struct<media: binary, landmarks: array<long>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def clip(t: bytes | None) -> dict:
            wav = to_wav(padded(t or b""))
            return {"media": wav, "landmarks": fingerprint(np.frombuffer(from_wav(wav), np.uint8))}

        kind = pa.struct([("media", pa.binary()), ("landmarks", pa.list_(pa.int64()))])
        for texts in batches:
            for i in range(0, len(texts), ROWS):  # given out slice by slice, so that a worker holds one
                yield pa.array([clip(t.as_py()) for t in texts[i : i + ROWS].cast(pa.binary())], kind)

    return docs.withColumn("_made", made(F.col(text))).withColumns({"media": F.col("_made.media"), "landmarks": F.col("_made.landmarks")}).drop("_made")


def summaries(clips: DataFrame, media: str = "media", landmarks: str = "landmarks") -> DataFrame:
    """clips (with landmarks) with a struct column ``read``: figures of the samples read back, and a digest of their fingerprint. Null clips have nulls; a column ``read`` is replaced."""

    @F.arrow_udf("struct<payload_bytes: long, payload_sha256: string, tail_crc32: long, feature: string>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
        for some, marks in batches:
            rows = []
            for m, own in zip(some, marks, strict=True):
                if not m.is_valid:
                    rows.append((None,) * 4)
                    continue
                samples, own = from_wav(m.as_py()), own.values.to_numpy(zero_copy_only=False)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), f"{len(own)}:{hashlib.sha256(own.astype('<i8').tobytes()).hexdigest()}"))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return clips.withColumn("read", of(F.col(media), F.col(landmarks)))


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of figures for each document: stored as WAV, its landmarks stored beside it, both read back. A map without a shuffle."""
    clips = summaries(with_clips(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")), "_text"))
    return clips.select(
        F.col("_id").alias(id), F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes"), "read.payload_bytes", "read.payload_sha256", "read.tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "read.feature", F.size("landmarks").cast("long").alias("n_landmarks"),
    )

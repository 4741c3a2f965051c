"""Energy of PCM audio per 10 ms bin: WAV files decoded, mixed down, band-passed, summed. Other codecs are refused by name."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelgrid.sources.ranged import opened, rows_of
from reelgrid.sources.shared import Watch, written

LOW_HZ, HIGH_HZ, Q, MARGIN = 300.0, 3400.0, 1 / math.sqrt(2), 0.45
STEP = 1 << 16
#: Seconds of a range of a file, and of what is read before it for the filters' state (fixed value).
RANGE_S, PREROLL_S = 600, 0.5


def _biquad(rate: int, hz: float, high: bool) -> tuple[np.ndarray, np.ndarray]:
    w = 2 * math.pi * hz / rate
    alpha, c = math.sin(w) / (2 * Q), math.cos(w)
    b = np.array([(1 + c) / 2, -(1 + c), (1 + c) / 2] if high else [(1 - c) / 2, 1 - c, (1 - c) / 2]) / (1 + alpha)
    return b, np.array([-2 * c, 1 - alpha]) / (1 + alpha)


def _impulse(rate: int, hz: float, high: bool) -> np.ndarray:
    """The filter's response until it is inaudible, so that it can be applied by convolution."""
    b, a = _biquad(rate, hz, high)
    out, x1, x2 = [], 0.0, 0.0
    for k in range(rate // 8):
        y = (b[k] if k < 3 else 0.0) - a[0] * x1 - a[1] * x2
        out.append(y)
        x1, x2 = y, x1
    return np.array(out)


def band(samples: np.ndarray, rate: int) -> np.ndarray:
    """Samples between LOW_HZ and HIGH_HZ; a corner too near half the rate is left out."""
    for hz, high in ((LOW_HZ, True), (HIGH_HZ, False)):
        if hz < MARGIN * rate and len(samples):
            h = _impulse(rate, hz, high)
            n = len(samples)
            size = 1 << (STEP + len(h) - 1).bit_length()
            spectrum, out = np.fft.rfft(h, size), np.zeros(n + len(h))
            for i in range(0, n, STEP):
                part = np.fft.irfft(np.fft.rfft(samples[i : i + STEP], size) * spectrum, size)[: len(samples[i : i + STEP]) + len(h) - 1]
                out[i : i + len(part)] += part
            samples = out[:n]
    return samples


def _samples(raw: bytes, width: int) -> np.ndarray:
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000).astype(np.float64)
    return np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64) - (128 if width == 1 else 0)


def energy_of(content: bytes) -> tuple[str, list[tuple[int, float, int]]]:
    """(outcome, [(bin, sum of squares, samples)]): outcome is ok, no-audio, or unreadable."""
    try:
        with wave.open(io.BytesIO(content), "rb") as w:
            rate, channels, width, n = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
            raw = w.readframes(n)
    except (wave.Error, EOFError):
        return "unreadable", []
    if not n:
        return "no-audio", []
    x = _samples(raw, width)
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1) / float(1 << 8 * width - 1)
    x = band(x, rate)
    bins = np.arange(len(x)) * 100 // rate
    return "ok", list(zip(range(int(bins[-1]) + 1), np.bincount(bins, x * x).tolist(), np.bincount(bins).tolist(), strict=True))


class _Filter:
    """A filter over samples that come in parts."""

    def __init__(self, rate: int, hz: float, high: bool):
        self.h = _impulse(rate, hz, high)
        self.size = 1 << (STEP + len(self.h) - 1).bit_length()
        self.spectrum, self.tail = np.fft.rfft(self.h, self.size), np.zeros(len(self.h) - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = np.fft.irfft(np.fft.rfft(x, self.size) * self.spectrum, self.size)[: len(x) + len(self.h) - 1]
        y[: len(self.tail)] += self.tail[: len(y)]
        rest = np.zeros(len(self.h) - 1)
        rest[: len(y) - len(x)] = y[len(x) :]
        self.tail = rest
        return y[: len(x)]


def streamed_energy(file, stop: Callable[[], bool] = lambda: False, begin: int = 0, end: int | None = None) -> Iterator[tuple[str, list[tuple[int, float, int]]]]:
    """energy_of() of an open WAV file, or its frames from begin to end, in parts of STEP frames, so that memory doesn't grow with it. The sums of a bin may come in two parts.

    The frames of PREROLL_S before begin are read for the filters' state, which reaches less far back: sums of ranges add up to those of one
    pass. stop is asked before each part; a reading that was stopped ends with the outcome "stopped".
    """
    try:
        w = wave.open(file, "rb")
    except (wave.Error, EOFError):
        yield "unreadable", []
        return
    rate, channels, width, n = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
    if not n:
        yield "no-audio", []
        return
    filters = [_Filter(rate, hz, high) for hz, high in ((LOW_HZ, True), (HIGH_HZ, False)) if hz < MARGIN * rate]
    at, last = max(0, begin - int(rate * PREROLL_S)), n if end is None else min(n, end)
    if at:
        w.setpos(at)
    while at < last and (raw := w.readframes(min(STEP, last - at))):
        if stop():
            yield "stopped", []
            return
        x = _samples(raw, width)
        x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1) / float(1 << 8 * width - 1)
        for f in filters:
            x = f(x)
        own = x[max(0, begin - at) :]
        if len(own):
            bins = (max(at, begin) + np.arange(len(own))) * 100 // rate
            first = int(bins[0])
            sums, counts = np.bincount(bins - first, own * own), np.bincount(bins - first)
            yield "ok", [(first + k, float(s), int(c)) for k, (s, c) in enumerate(zip(sums, counts, strict=True))]
        at += len(x)


def ranges_of(paths: DataFrame, seconds: int) -> DataFrame:
    """(path, outcome, begin, end): the ranges of frames of each WAV file at paths (path), read from its header alone; a refused file has one row without a range."""

    def make(path: str) -> Iterator[dict]:
        none = {"path": path, "begin": None, "end": None}
        try:
            with opened(path) as f, wave.open(f, "rb") as w:
                n, step = w.getnframes(), max(1, w.getframerate() * seconds)
        except (OSError, wave.Error, EOFError):
            yield none | {"outcome": "unreadable"}
            return
        if not n:
            yield none | {"outcome": "no-audio"}
        for k in range(0, n, step):
            yield {"path": path, "outcome": "ok", "begin": k, "end": min(n, k + step)}

    arrow = pa.schema([("path", pa.string()), ("outcome", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])
    return rows_of(paths, make, arrow, "path string, outcome string, begin long, end long")


def energy_at(paths: DataFrame, seconds: int = RANGE_S, watch: Watch | None = None) -> DataFrame:
    """energy() of the files at paths (path), by ranges of ``seconds``: a long file is many tasks. A bin's sums may come in several rows, which levels() adds up.

    watch: counts the ranges that are done, and is asked whether to stop.
    """
    arrow = pa.schema([("film", pa.string()), ("outcome", pa.string()), ("bin", pa.int64()), ("sum_sq", pa.float64()), ("n", pa.int64())])
    planned = written(ranges_of(paths, seconds), "ranges")
    count = planned.count()
    stop, done = (watch.begun(count), watch.done) if watch else ((lambda: False), None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path, outcome = row["path"], row["outcome"]
                found = iter([(outcome, [])])
                try:
                    if outcome == "ok":
                        with opened(path) as f:
                            for said, rows in streamed_energy(f, stop, row["begin"], row["end"]):
                                yield pa.RecordBatch.from_pylist([{"film": path, "outcome": said, "bin": b, "sum_sq": s, "n": n} for b, s, n in rows or [(None, None, None)]], arrow)
                        found = iter(())
                except OSError:
                    found = iter([("unreadable", [])])
                for said, _ in found:
                    yield pa.RecordBatch.from_pylist([{"film": path, "outcome": said, "bin": None, "sum_sq": None, "n": None}], arrow)
                if done is not None:
                    done.add(1)

    tasks = max(1, min(count, 1 << 16))
    dealt = planned.repartitionByRange(tasks, "path", "begin") if count > 1 else planned
    return dealt.mapInArrow(read, "film string, outcome string, bin long, sum_sq double, n long")


def energy(files: DataFrame) -> DataFrame:
    """(film, outcome, bin, sum_sq, n) of WAV files (path, content); a refused file has one row without a bin."""
    arrow = pa.schema([("film", pa.string()), ("outcome", pa.string()), ("bin", pa.int64()), ("sum_sq", pa.float64()), ("n", pa.int64())])

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py()
                outcome, rows = energy_of(batch.column(1)[i].as_py() or b"")
                rows = rows or [(None, None, None)]
                for k in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_pylist([{"film": path, "outcome": outcome, "bin": b, "sum_sq": s, "n": n} for b, s, n in rows[k : k + 50_000]], arrow)

    return files.select("path", "content").mapInArrow(read, "film string, outcome string, bin long, sum_sq double, n long")

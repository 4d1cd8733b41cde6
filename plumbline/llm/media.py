"""Media columns: texts as WAV sound, read back, and spectral-peak pair fingerprints of it.

The wave module writes and reads 8-bit mono samples. A short-time Fourier transform gives each frame's strongest
bin in a few bands; pairs of peaks a frame or two apart become codes that carry the time of the first.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, text_bytes

BLOCK, PAD = 576, b"\xff"
FRAME, HOP, RATE = 288, 144, 8000
#: Bins of a frame's spectrum from which one peak each is taken; fixed values.
BANDS = ((1, 12), (12, 48), (48, 145))
_WINDOW = np.hanning(FRAME).astype(np.float32)


def pad(raw: bytes) -> bytes:
    """Padded to a positive multiple of BLOCK bytes."""
    return raw + PAD * (-len(raw) % BLOCK if raw else BLOCK)


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def read_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(payload: bytes, frames_at_once: int = 2048) -> np.ndarray:
    """Per frame the strongest bin of each band; 0 where a band is silent."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    if len(samples) < FRAME:
        return np.zeros((0, len(BANDS)), dtype=np.int64)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.zeros((len(frames), len(BANDS)), dtype=np.int64)
    for a in range(0, len(frames), frames_at_once):
        part = (frames[a : a + frames_at_once].astype(np.float32) - np.float32(128)) * _WINDOW
        power = np.abs(np.fft.rfft(part, axis=1))
        for k, (low, high) in enumerate(BANDS):
            band = power[:, low:high]
            best = band.argmax(axis=1)
            loud = band[np.arange(len(band)), best] > 1e-3
            out[a : a + frames_at_once, k] = np.where(loud, best + low, 0)
    return out


def pair_codes(found: np.ndarray) -> np.ndarray:
    """Sorted codes time << 24 | first bin << 14 | second bin << 4 | frames between, one per pair of a peak and
    the peak of the next band one or two frames later."""
    out, n = [], len(BANDS)
    for apart in (1, 2):
        for k in range(n):
            first, second = found[:-apart, k], found[apart:, (k + apart) % n]
            time = np.arange(len(first))
            good = (first > 0) & (second > 0)
            out.append((time << 24 | first << 14 | second << 4 | apart)[good])
    return np.sort(np.concatenate(out))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_bytes (of the text), media (the WAV file), payload (its samples, read back), and
    fingerprint (array of time-coded pairs of spectral peaks).

    A null or empty text is one block of padding. Repeated and null ids stay, one row each; other columns aren't
    read. A text of any length is transformed a bounded number of frames at a time. One pass, no shuffle.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = text_bytes(batch.column(1))
        stored = [write_wav(pad(t)) for t in raw]
        back = [read_wav(m) for m in stored]
        codes = [pair_codes(peaks(p)) for p in back]
        offsets = np.zeros(len(codes) + 1, dtype=np.int32)
        np.cumsum([len(c) for c in codes], out=offsets[1:])
        prints = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(codes) if codes else np.empty(0, np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(stored, pa.binary()), pa.array(back, pa.binary()), prints], names=[id_col, "n_bytes", "media", "payload", "fingerprint"])

    picked = docs.select(F.col(id_col), F.col(text_col))
    return mapped(picked, work, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, n_bytes long, media binary, payload binary, fingerprint array<long>", 2 << 20)

"""Media columns: WAV payloads, short-time Fourier transforms, spectral-peak pair fingerprints.

A payload becomes a mono WAV of 8-bit samples; the wave module writes it and reads it back. Half
overlapping windows of the samples are transformed, each window keeps its loudest bands' peaks, and pairs of near peaks become the
fingerprint: arrays of (time, code), where a code holds both frequencies and the gap between them.

Defined results: a null text is an empty one; the payload is padded by zero bytes to a positive multiple of
64, so an empty text is 64 zero bytes with an empty fingerprint; very long texts are read in runs of windows;
equal texts give equal values; other columns stay, and columns named like a result are replaced.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 8000
UNIT = 64
WINDOW = 256
HOP = WINDOW // 2
#: Frequency ranges of which each window keeps the loudest bin.
BANDS = ((2, 8), (8, 16), (16, 32), (32, 64), (64, 128))
#: Windows ahead within which a peak is paired.
REACH = 3
_TAPER = np.hanning(WINDOW).astype(np.float32)

MEDIA = T.StructType([
    T.StructField("n_bytes", T.LongType()),
    T.StructField("media", T.BinaryType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("times", T.ArrayType(T.IntegerType())),
    T.StructField("codes", T.ArrayType(T.IntegerType())),
])


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def spectrogram(samples: np.ndarray) -> np.ndarray:
    """Magnitudes, one row a window; the last window is filled with silence."""
    windows = -(-len(samples) // HOP)
    padded = np.full((windows - 1) * HOP + WINDOW, 128, np.uint8)
    padded[: len(samples)] = samples[: len(padded)]
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP].astype(np.float32) - 128
    return np.abs(np.fft.rfft(frames * _TAPER))


def fingerprint(samples: np.ndarray, run: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """times and codes of all pairs of a peak with the peaks of the next REACH windows, in order of (time, code)."""
    bins, loud = [], []
    for low in range(0, len(samples), run * HOP):
        power = spectrogram(samples[low : low + run * HOP])
        best = [power[:, a:b].argmax(1) + a for a, b in BANDS]
        bins.append(np.stack(best, 1))
        loud.append(np.stack([np.take_along_axis(power, x[:, None], 1)[:, 0] for x in best], 1))
    peak, strength = np.concatenate(bins), np.concatenate(loud)
    is_peak = strength > strength.mean(1, keepdims=True)  # a constant stretch has no peaks
    times, codes = [], []
    for gap in range(1, min(REACH, len(peak) - 1) + 1):
        both = is_peak[:-gap, :, None] & is_peak[gap:, None, :]
        at, a, b = np.nonzero(both)
        times.append(at)
        codes.append(peak[at, a] << 16 | peak[at + gap, b] << 8 | gap)
    if not times:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


def add_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_bytes, media (WAV), payload (read back) and the fingerprint's times and codes. One pass, no shuffle."""
    kept = [c for c in docs.columns if c != text and c.lower() not in {f.name for f in MEDIA.fields}]
    schema = T.StructType([*[docs.schema[c] for c in kept], *MEDIA.fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), 256):
                batch = whole.slice(low, 256)
                sizes, medias, payloads, times, codes = [], [], [], [], []
                for value in batch.column(len(kept)).to_pylist():
                    raw = (value or "").encode()
                    media = to_wav(payload_of(raw))
                    back = from_wav(media)
                    time, code = fingerprint(np.frombuffer(back, np.uint8))
                    sizes.append(len(raw))
                    medias.append(media)
                    payloads.append(back)
                    times.append(time)
                    codes.append(code)
                arrays = [pa.array(sizes, pa.int64()), pa.array(medias, pa.binary()), pa.array(payloads, pa.binary()), pa.array(times, pa.list_(pa.int32())), pa.array(codes, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], names=[*kept, *[f.name for f in MEDIA.fields]])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text)).mapInArrow(encode, schema)

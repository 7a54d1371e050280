"""Audio bytes. Encoders other than WAV and raw PCM aren't installed here and are left to plug-ins."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 24_000
ENCODERS: dict[str, Callable[[np.ndarray, int], bytes]] = {}


def pcm_bytes(samples: np.ndarray) -> bytes:
    """16-bit little-endian samples, cut off towards zero; out of range is clipped."""
    return (np.clip(np.asarray(samples, np.float32), -1.0, 1.0) * 32767).astype("<i2").tobytes()


def wav_bytes(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(pcm_bytes(samples))
    return out.getvalue()


def encode(samples: np.ndarray, fmt: str, rate: int = RATE) -> bytes:
    """One header for a whole utterance. "aac" has no encoder that writes AAC, so it is refused rather than mislabelled."""
    if fmt == "wav":
        return wav_bytes(samples, rate)
    if fmt == "pcm":
        return pcm_bytes(samples)
    if fmt in ENCODERS:
        return ENCODERS[fmt](samples, rate)
    raise ValueError(f"no encoder for {fmt}")


def encoded(samples: Column, fmt: str = "wav", rate: int = RATE) -> Column:
    """Bytes of an array of samples; null for null or no samples."""

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([encode(np.array(x.as_py(), np.float32), fmt, rate) if x.as_py() else None for x in batch], pa.binary())

    return of(samples)


def joined(parts: Column) -> Column:
    """The bytes of an array, one after the other; nulls are passed over."""

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x.as_py() is None else b"".join(p for p in x.as_py() if p) for x in batch], pa.binary())

    return of(parts)


def wav_duration_ms(data: Column) -> Column:
    """Length of a WAV file; null if it isn't one."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch:
                try:
                    with wave.open(io.BytesIO(x.as_py() or b"")) as f:
                        out.append(int(f.getnframes() / f.getframerate() * 1000))
                except (wave.Error, EOFError):
                    out.append(None)
            yield pa.array(out, pa.int64())

    return of(data)

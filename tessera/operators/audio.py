"""Audio: files to mono samples, resampling, framing, log-mel spectra and embeddings.

Samples are arrays of floats in rows; the numeric steps run on Arrow batches with
numpy.  Only uncompressed WAV is decoded here; other decoders and real encoders are
passed in as functions.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import RequestError
from tessera.functions.vectors import col

#: Extensions that are scanned for, and parameters of the two spectra.
EXTENSIONS = ("wav", "flac", "mp3", "ogg", "m4a", "aac")
RATE, N_FFT, HOP, MELS = 48_000, 1024, 480, 64
SMALL = {"rate": 16_000, "n_fft": 400, "hop": 160, "mels": 64, "low": 125.0, "high": 7500.0}


def decode_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """(mono samples in -1..1, rate): the mean of the channels of 8, 16, 24 or 32-bit PCM."""
    with wave.open(io.BytesIO(raw)) as f:
        width, channels, rate, data = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    if width == 1:
        values = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        whole = parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16
        values = (whole - ((whole >> 23) << 24)) / float(1 << 23)
    elif width in (2, 4):
        values = np.frombuffer(data, f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
    else:
        raise RequestError(f"WAV samples of {width} bytes")
    return values.reshape(-1, channels).mean(axis=1).astype(np.float32), rate


def read(spark: SparkSession, folder: str, decode: Callable[[bytes], tuple[np.ndarray, int]] = decode_wav) -> DataFrame:
    """path, rate, samples and error of the audio files under ``folder``; a file that cannot be decoded has its error and no samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    samples, rate = decode(content.as_py())
                    row = (path, rate, samples, None)
                except Exception as e:  # noqa: BLE001  any decoder's error is the file's
                    row = (path, None, None, f"{type(e).__name__}: {e}")
                kinds = (pa.string(), pa.int32(), pa.list_(pa.float32()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["path", "rate", "samples", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS)
    return files.filter(wanted).select("path", "content").mapInArrow(run, "path string, rate int, samples array<float>, error string")


def resample(samples: np.ndarray, rate: int, to: int, taps: int = 256) -> np.ndarray:
    """Windowed-sinc resampling to floor(n * to / rate) samples; equal rates pass through."""
    if rate == to or not len(samples):
        return samples
    ratio = to / rate
    n = int(len(samples) * to // rate)
    cut = min(1.0, ratio)
    at = np.arange(n) / ratio
    half = taps // 2
    base = np.floor(at).astype(np.int64)
    padded = np.pad(samples.astype(np.float64), half)
    out = np.zeros(n)
    for tap in range(-half + 1, half + 1):
        x = at - (base + tap)
        phase = np.clip((x / half + 1) / 2, 0, 1) * 2 * np.pi
        window = 0.35875 - 0.48829 * np.cos(phase) + 0.14128 * np.cos(2 * phase) - 0.01168 * np.cos(3 * phase)
        out += padded[base + tap + half] * cut * np.sinc(cut * x) * window
    return out.astype(np.float32)


def resampled(rows: DataFrame, to: int = RATE) -> DataFrame:
    """``rows`` (rate, samples) at the rate ``to``."""

    @F.pandas_udf("array<float>")
    def convert(samples: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else resample(np.asarray(s, dtype=np.float32), int(r), to) for s, r in zip(samples, rates, strict=True)])

    return rows.withColumn("samples", convert("samples", "rate")).withColumn("rate", F.lit(to))


def window_ranges(n: str | Column, width: int, hop: int) -> Column:
    """(start, end) sample ranges: fixed strides, the tail dropped; one short window if there are fewer samples, none of none."""
    size = col(n).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), size - width, F.lit(max(hop, 1)).cast("long"))
    several = F.transform(starts, lambda s: F.struct(s.alias("start"), (s + width).alias("end")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))
    return F.when(size >= width, several).when(size > 0, one).otherwise(F.slice(one, 1, 0))


def hop_for(width: int, overlap: float = 0.5) -> int:
    return max(1, int((1.0 - overlap) * width))


def frames(rows: DataFrame, width: int, hop: int, key: str = "path") -> DataFrame:
    """(key, start, samples) of each window."""
    return rows.select(key, "samples", F.explode(window_ranges(F.size("samples"), width, hop)).alias("w")).select(
        key, F.col("w.start").alias("start"), F.slice("samples", (F.col("w.start") + 1).cast("int"), (F.col("w.end") - F.col("w.start")).cast("int")).alias("samples"))


def spectral_flux(spectrum: np.ndarray) -> np.ndarray:
    """Root of the summed squares of each frame's rises over the one before; 0 for the first.  ``spectrum``: frames x bins."""
    rise = np.maximum(np.diff(spectrum, axis=0), 0) if len(spectrum) > 1 else np.zeros((0, 0))
    return np.concatenate([np.zeros(min(1, len(spectrum))), np.sqrt((rise**2).sum(axis=1))])


def transient_ranges(n: int, width: int, spectrum: np.ndarray, hop: int, sensitivity: float = 0.5) -> list[tuple[int, int]]:
    """Half-overlapping windows whose ends move, by a tenth at most, to take in transients in their outer tenths.

    A transient is a flux over the mean and ``sensitivity`` (0 to 1) deviations.
    """
    flux = spectral_flux(spectrum)
    if not len(flux):
        return []
    limit = flux.mean() + min(max(sensitivity, 0.0), 1.0) * flux.std()
    step = max(1, width // 2)
    ranges = [(0, n)] if 0 < n < width else [(s, s + width) for s in range(0, n - width + 1, step)] if n else []
    loud, most, out = flux > limit, width // 10, []
    for start, end in ranges:
        first, last = start // hop, min(end // hop, len(flux) - 1)
        zone = max(0, last - first) // 10
        at_start = np.flatnonzero(loud[first : first + zone])
        at_end = np.flatnonzero(loud[max(0, last - zone) : last])
        if len(at_start):
            new_start = max(0, start - min(most, max(0, (first + int(at_start[0])) * hop - start)))
        else:
            new_start = start
        if len(at_end):
            end = min(n, end + min(most, max(0, end - (max(0, last - zone) + int(at_end[0])) * hop)))
        out.append((new_start, end))
    return out


def filterbank(rate: int = RATE, n_fft: int = N_FFT, mels: int = MELS, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangles of equal width on the mel scale, each divided by half its width in hertz: mels x bins."""
    to_mel = lambda hz: 2595.0 * np.log10(1.0 + hz / 700.0)
    points = 700.0 * (10.0 ** (np.linspace(to_mel(low), to_mel(high or rate / 2), mels + 2) / 2595.0) - 1.0)
    place = points * n_fft / rate
    bins = np.arange(n_fft // 2 + 1)[None, :]
    left, middle, right = (place[k : mels + k, None] for k in range(3))
    rising, falling = (bins - left) / (middle - left + 1e-10), (right - bins) / (right - middle + 1e-10)
    return np.maximum(0, np.minimum(rising, falling)) * (2.0 / (points[2:] - points[:-2]))[:, None]


def power_spectrum(samples: np.ndarray, n_fft: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """frames x bins: periodic Hann windows over samples mirrored at both ends, edge sample included."""
    samples = np.asarray(samples, dtype=np.float64)
    pad = n_fft // 2
    padded = np.concatenate([samples[:pad][::-1], samples, samples[::-1][:pad]])
    n = (len(padded) - n_fft) // hop + 1 if len(samples) and len(padded) >= n_fft else 0
    if n <= 0:
        return np.zeros((0, n_fft // 2 + 1))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    view = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop][:n]
    return np.abs(np.fft.rfft(view * window, axis=1)) ** 2


def log_mel(samples: np.ndarray, rate: int = RATE, n_fft: int = N_FFT, hop: int = HOP, mels: int = MELS) -> np.ndarray:
    """mels x frames: natural logarithm of the mel power, 1e-10 at least."""
    return np.log(np.maximum(filterbank(rate, n_fft, mels) @ power_spectrum(samples, n_fft, hop).T, 1e-10))


def log_mel_db(samples: np.ndarray) -> np.ndarray:
    """mels x frames in decibels below the loudest, 80 at most: the small spectrum."""
    p = SMALL
    power = filterbank(p["rate"], p["n_fft"], p["mels"], p["low"], p["high"]) @ power_spectrum(samples, p["n_fft"], p["hop"]).T
    db = 10 * np.log10(np.maximum(power, 1e-10))
    return np.maximum(db - db.max(), -80.0) if db.size else db


def with_log_mel(rows: DataFrame, rate: int = RATE) -> DataFrame:
    """``rows`` (samples) with log_mel: an array of mel rows."""

    @F.pandas_udf("array<array<double>>")
    def spectrum(samples: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else log_mel(np.asarray(s), rate).tolist() for s in samples])

    return rows.withColumn("log_mel", spectrum("samples"))


#: A batch of inputs (sample arrays, or texts) to a batch of vectors.
Encoder = Callable[[list], np.ndarray]


def hashing_encoder(dim: int = 128, seed: int = 0) -> Encoder:
    """A stand-in without a model: each input's own seeded normal vector."""

    def run(inputs: list) -> np.ndarray:
        import hashlib

        out = np.empty((len(inputs), dim))
        for i, x in enumerate(inputs):
            raw = x.encode() if isinstance(x, str) else np.asarray(x, dtype=np.float32).tobytes()
            out[i] = np.random.default_rng([seed, int.from_bytes(hashlib.sha256(raw).digest()[:8], "little")]).normal(size=dim)
        return out

    return run


def onnx_encoder(path: str, sha256: str = "") -> Encoder:
    """A model file that takes a batch and returns vectors; its digest is verified if given.  Loaded once in each process."""
    held: list = []

    def run(inputs: list) -> np.ndarray:
        if not held:
            import hashlib

            import onnxruntime

            with open(path, "rb") as f:
                raw = f.read()
            if sha256 and hashlib.sha256(raw).hexdigest() != sha256.lower():
                raise RequestError(f"{path} does not match its digest")
            held.append(onnxruntime.InferenceSession(raw, providers=["CPUExecutionProvider"]))
        session = held[0]
        return session.run(None, {session.get_inputs()[0].name: np.asarray(inputs, dtype=np.float32)})[0]

    return run


def embedded(rows: DataFrame, column: str, encoder: Encoder) -> DataFrame:
    """``rows`` with vector: the encoder's output of ``column``, divided by its norm if that is over 1e-6."""

    @F.pandas_udf("array<float>")
    def encode(values: pd.Series) -> pd.Series:
        some = [v for v in values if v is not None]
        if not some:
            return pd.Series([None] * len(values), dtype=object)
        vectors = np.asarray(encoder(some), dtype=np.float64)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = iter(np.where(norms > 1e-6, vectors / np.maximum(norms, 1e-6), vectors).astype(np.float32))
        return pd.Series([None if v is None else next(unit) for v in values], dtype=object)

    return rows.withColumn("vector", encode(column))

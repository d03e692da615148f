"""Operator 2: media columns. WAV bytes are read by the wave module, turned into a short-time Fourier
spectrum, and its peaks, paired, give fingerprints: one number for each pair of an anchor and a later
peak, coded with the anchor's time, so that two recordings can be aligned by the difference of times.

Everything happens in one map stage over the rows; nothing is shuffled. A recording is read and transformed
in blocks of frames, so that its length costs no memory but that of its bytes and its peaks.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.chunks import by_batches, runs
from tessera.plans.columns import pick
from tessera.sources.tables import table

FFT, HOP = 256, 128
#: Half sizes of the neighbourhood (frames, bins) in which a peak is the only largest value.
NEAR = (3, 5)
#: Peaks are at least this much below the loudest of the recording (as a ratio of magnitudes).
FLOOR = 0.05
#: Later peaks that an anchor is paired with, and frames up to which they may be away: the pairs of a peak
#: that the fingerprint is made of, by the definition of the method.
FAN, REACH = 5, 31
#: Frames of a block.
BLOCK = 2048
RATE, NOTE = 8000, 256


def _samples(data: bytes, width: int, channels: int) -> np.ndarray:
    """Mono samples in -1..1 of PCM frames."""
    if width == 1:
        x = np.frombuffer(data, np.uint8).astype(np.float64) - 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float64)
    else:
        x = np.frombuffer(data, f"<i{width}").astype(np.float64)
    return x.reshape(-1, channels).mean(axis=1) / float(1 << (8 * width - 1))


def read_wav(raw: bytes | None, block: int = BLOCK * HOP) -> tuple[int, Iterator[np.ndarray]] | None:
    """(sample rate, mono samples in blocks) of PCM WAV bytes; None where they are none."""
    if not raw:
        return None
    try:
        w = wave.open(io.BytesIO(raw))
        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
    except (wave.Error, EOFError, ValueError):
        return None
    if width not in (1, 2, 3, 4) or not channels:
        return None

    def blocks() -> Iterator[np.ndarray]:
        while data := w.readframes(block):
            whole = len(data) // (width * channels) * width * channels
            if whole:
                yield _samples(data[:whole], width, channels)
            if whole < len(data):
                return

    return rate, blocks()


def spectrum(x: np.ndarray) -> np.ndarray:
    """Magnitudes (frames, bins) of Hann-windowed frames; a short rest at the end is left out."""
    if len(x) < FFT:
        return np.zeros((0, FFT // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, FFT)[::HOP]
    return np.abs(np.fft.rfft(frames * np.hanning(FFT), axis=1))


def _largest(s: np.ndarray, reach: int, axis: int) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (reach, reach)
    p = np.pad(s, pad, constant_values=-1.0)
    out, n = s.copy(), s.shape[axis]
    for k in range(2 * reach + 1):
        np.maximum(out, p[k : k + n] if axis == 0 else p[:, k : k + n], out=out)
    return out


def peaks(blocks: Iterable[np.ndarray]) -> tuple[np.ndarray, int]:
    """((frame, bin) of the values that are the largest of their neighbourhood and above the floor, in order
    of time, then frequency; number of samples) of a recording in blocks of samples. Equal values are
    both peaks; silence has none. Each block of frames is looked at with its neighbours' edges."""
    near, found, loud, size = NEAR[0], [], 0.0, 0
    rest, edge, first = np.zeros(0), np.zeros((0, FFT // 2 + 1)), 0  # samples; frames not yet done, with the number of the first

    def look(s: np.ndarray, begin: int, end: int) -> None:
        top = _largest(_largest(s, near, 0), NEAR[1], 1)[begin:end]
        own = s[begin:end]
        at = np.argwhere((own == top) & (own > 0))
        found.append((at + [first + begin, 0], own[at[:, 0], at[:, 1]]))

    for x in blocks:
        size += len(x)
        rest = np.concatenate([rest, x])
        s = spectrum(rest)
        rest = rest[len(s) * HOP :]
        loud = max(loud, float(s.max(initial=0)))
        s = np.concatenate([edge, s])
        begin = 0 if not first else near
        if len(s) > begin + 2 * near:
            end = len(s) - near
            look(s, begin, end)
            edge, first = s[end - near :], first + end - near
        else:
            edge = s
    if len(edge):
        look(edge, 0 if not first else near, len(edge))
    if not found or loud <= 0:
        return np.zeros((0, 2), np.int64), size
    at, high = (np.concatenate(c) for c in zip(*found, strict=True))
    return at[high >= FLOOR * loud], size


def fingerprints(at: np.ndarray) -> np.ndarray:
    """anchor frame << 32 | anchor bin << 20 | other bin << 8 | frames between, for each peak and the
    FAN next ones of later frames up to REACH frames away."""
    at = at.astype(np.int64)
    frame = at[:, 0]
    lo = np.searchsorted(frame, frame, side="right")
    n = np.minimum(np.searchsorted(frame, frame + REACH, side="right") - lo, FAN)
    one, other = np.repeat(np.arange(len(at)), n), np.repeat(lo, n) + runs(n)
    return frame[one] << 32 | at[one, 1] << 20 | at[other, 1] << 8 | frame[other] - frame[one]


def fingerprint(media: DataFrame, id: str = "id", wav: str = "wav") -> DataFrame:
    """(id, sample_rate, n_samples, n_peaks, fingerprints) of every row.

    Null, empty or damaged bytes have a null sample rate, no samples and no fingerprints; silence and
    recordings under one frame have no peaks; recordings may be of any length; ids may be null or
    repeated; other columns, whatever their names, are not looked at; an empty table gives an empty one."""
    own = pick(media, id=id, wav=wav)
    kind = own.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rate, size, count, marks = [], [], [], []
                for raw in part.column("wav"):
                    read = read_wav(raw.as_py())
                    at, samples = peaks(read[1] if read else ())
                    rate.append(read[0] if read else None)
                    size.append(samples)
                    count.append(len(at))
                    marks.append(fingerprints(at))
                columns = [part.column("id"), pa.array(rate, pa.int64()), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(marks, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[id, "sample_rate", "n_samples", "n_peaks", "fingerprints"])

    return by_batches(own, run, f"`{id}` {kind}, sample_rate bigint, n_samples bigint, n_peaks bigint, fingerprints array<bigint>")


def tones(values: list[float] | None) -> bytes:
    """A 16-bit mono WAV with one short tone for each number of a vector; null ones are silent."""
    v = np.array([np.nan if x is None else x for x in values or []], np.float64)
    hertz = np.repeat(300 + 1650 * (1 + np.tanh(np.nan_to_num(v))), NOTE)
    sound = np.sin(np.cumsum(2 * np.pi * hertz / RATE)) * np.repeat(np.isfinite(v) * 0.8, NOTE)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((sound * 32767).astype("<i2").tobytes())
    return out.getvalue()


def render(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, wav): each vector as a recording, as the given tables hold none."""
    own = pick(vectors, id=id, vector=vector)
    kind = own.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([tones(x) for x in part.column("vector").to_pylist()], pa.binary())], names=["id", "wav"])

    return by_batches(own, run, f"id {kind}, wav binary")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all embeddings, each rendered as a recording of two seconds."""
    return fingerprint(render(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")

"""Audio: PCM WAV decoding, resampling, and log filterbank features in numpy."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np

ALL, NUM_FRAMES, NUM_CHANNELS, SAMPLE_RATE, NUM_SECONDS = "all", "num_frames", "num_channels", "sample_rate", "num_seconds"


def wav_info(data: bytes) -> tuple[int, int, int]:
    """(frames, channels, rate) from the header."""
    with wave.open(io.BytesIO(data)) as w:
        return w.getnframes(), w.getnchannels(), w.getframerate()


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """[frames, channels] floats in -1 .. 1, and the rate; PCM of 8, 16, 24 or 32 bits."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            n, channels, width, rate = w.getnframes(), w.getnchannels(), w.getsampwidth(), w.getframerate()
            raw = w.readframes(n)
    except (wave.Error, EOFError) as e:
        raise ValueError(f"only PCM WAV is decoded here: {e}") from e
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / (1 << (8 * width - 1))
    return x.astype(np.float32).reshape(-1, channels), rate


def info_value(info: tuple[int, int, int], kind: str):
    frames, channels, rate = info
    return {ALL: [frames, channels, rate], NUM_FRAMES: frames, NUM_CHANNELS: channels, SAMPLE_RATE: rate, NUM_SECONDS: frames / rate}[kind]


def resample(x: np.ndarray, rate: int, to: int, quality: str = "linear") -> np.ndarray:
    """[frames, channels] at another rate; ``zero-order-hold`` or ``linear``, sinc qualities need a codec library."""
    if quality not in ("zero-order-hold", "linear"):
        raise ValueError(f"{quality} needs a resampling library; zero-order-hold and linear don't")
    if rate <= 0 or to <= 0:
        raise ValueError("rates must be positive")
    n = int(np.floor(len(x) * to / rate))
    at = np.arange(n) * (rate / to)
    low = np.minimum(at.astype(np.int64), max(len(x) - 1, 0))
    if quality == "zero-order-hold" or not n:
        return x[low].astype(np.float32)
    high = np.minimum(low + 1, len(x) - 1)
    part = (at - low)[:, None]
    return (x[low] * (1 - part) + x[high] * part).astype(np.float32)


def frames(x: np.ndarray, window: int, stride: int) -> np.ndarray:
    """Whole frames only: [n, window] of a one-dimensional signal."""
    n = 1 + (len(x) - window) // stride if len(x) >= window else 0
    return x[np.arange(n)[:, None] * stride + np.arange(window)[None, :]] if n else np.zeros((0, window), x.dtype)


_TO = {"mel": lambda f: 2595.0 * np.log10(1 + f / 700.0), "log10": lambda f: np.log10(f), "linear": lambda f: f}
_FROM = {"mel": lambda m: 700.0 * (10 ** (m / 2595.0) - 1), "log10": lambda m: 10.0**m, "linear": lambda m: m}


def filterbank(n: int, bins: int, rate: float, low: float = 0.0, high: float = -1, scale: str = "mel") -> np.ndarray:
    """[bins, n] triangles evenly spaced on the scale."""
    high = rate / 2 if high <= 0 else high
    if scale == "log10":
        low = max(low, 1.0)
    edges = _FROM[scale](np.linspace(_TO[scale](low), _TO[scale](high), n + 2))
    at = np.linspace(0, rate / 2, bins)
    rise = (at[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])[None, :]
    fall = (edges[None, 2:] - at[:, None]) / (edges[2:] - edges[1:-1])[None, :]
    return np.maximum(0, np.minimum(rise, fall))


def mfsc(
    n_filterbank: int,
    sampling_freq: int,
    frame_size_ms: float = 25,
    frame_stride_ms: float = 10,
    preemphasis: float = 0.97,
    low_freq: float = 0,
    high_freq: float = -1,
    mel_floor: float = 1.0,
    window: str = "hamming",
    scale: str = "mel",
) -> Callable[[np.ndarray], np.ndarray]:
    """A function from a signal in -1 .. 1 to [frames, n_filterbank] log filterbank energies.

    Frames are taken first and pre-emphasised each on its own; the spectrum is
    the magnitude, and energies below the floor are lifted to it before the logarithm.
    """
    size, stride = int(sampling_freq * frame_size_ms / 1000), int(sampling_freq * frame_stride_ms / 1000)
    taper = np.hamming(size) if window == "hamming" else np.hanning(size)
    n_fft = 1 << (size - 1).bit_length()
    bank = filterbank(n_filterbank, n_fft // 2 + 1, sampling_freq, low_freq, high_freq, scale)

    def run(x: np.ndarray) -> np.ndarray:
        f = frames(np.asarray(x, np.float64).reshape(-1) * 32768.0, size, stride)
        f = f - preemphasis * np.concatenate((f[:, :1], f[:, :-1]), axis=1)
        spectrum = np.abs(np.fft.rfft(f * taper, n_fft))
        return np.log(np.maximum(spectrum @ bank, mel_floor)).astype(np.float32)

    return run

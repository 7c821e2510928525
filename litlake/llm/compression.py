"""Compressed sizes under raw-content zstandard dictionaries, and their calibration."""

from __future__ import annotations

import numpy as np
import zstandard

LEVEL = 3


def coder(dictionary: bytes) -> zstandard.ZstdCompressor:
    """A compressor over ``dictionary``; plain where the dictionary is too short to use."""
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(
            level=LEVEL, write_content_size=False, write_checksum=False
        )
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL,
        dict_data=content,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )


def windows(data: bytes, size: int) -> list[bytes]:
    """Windows that cover all of ``data``; the last one is ``size`` long too, if data is."""
    if len(data) <= size:
        return [data] if data else []
    last = len(data) - size
    return [data[i : i + size] for i in range(0, last, size)] + [data[last:]]


def gains(parts: list[bytes], against: zstandard.ZstdCompressor, own: zstandard.ZstdCompressor):
    """Bytes that ``own`` saves over ``against``, for each part."""
    return np.array([len(against.compress(p)) - len(own.compress(p)) for p in parts], dtype=float)


def fit_logistic(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 60
):
    """Weights of a logistic curve over the columns of ``x`` (intercept first), by Newton steps."""
    weight = np.ones(len(x)) if weight is None else weight
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + ridge * len(x) * w * (np.arange(len(w)) > 0)
        hess = (a * (weight * p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[1:] / scale
    return float(w[0] - slope @ mean), slope


def logistic(x: np.ndarray, intercept: float, slope: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(intercept + x @ slope, -30, 30)))

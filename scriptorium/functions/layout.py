"""Page layout: column statistics of scans, the gutter between two pages, and a small linear model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.vectorized import vectorized

COLUMNS = "struct<mean:array<double>,low:array<double>,p10:array<double>,p25:array<double>,median:array<double>,dark_run:array<double>,transitions:array<double>,dark_std:array<double>>"
DARK = 180


def column_stats(pixels: np.ndarray, dark: int = DARK) -> dict[str, np.ndarray]:
    """Statistics of each column of a grey image (height x width), all columns at once."""
    height = len(pixels)
    order = np.sort(pixels, axis=0).astype(float)
    is_dark = pixels < dark
    run = np.zeros(pixels.shape[1], dtype=int)
    best = run.copy()
    for row in is_dark:
        run = np.where(row, run + 1, 0)
        np.maximum(best, run, out=best)
    quarter = order[: max(int(height * 0.25), 1)]
    return {
        "mean": pixels.mean(axis=0),
        "low": order[0],
        "p10": order[int(height * 0.1)],
        "p25": order[int(height * 0.25)],
        "median": order[int(height * 0.5)],
        "dark_run": best / height * 100,
        "transitions": (is_dark[1:] != is_dark[:-1]).sum(axis=0).astype(float),
        "dark_std": quarter.std(axis=0),
    }


def gutter(stats: dict[str, np.ndarray], begin: float = 0.35, end: float = 0.65) -> tuple[int, float]:
    """Place and score of the best column for a split within a band: dark, in one run, without text."""
    n = len(stats["p10"])
    a, b = int(n * begin), int(n * end)
    score = (
        0.3 * (255 - stats["p10"]) / 2.55
        + 0.35 * stats["dark_run"]
        + 0.2 * np.maximum(0, 100 - stats["transitions"] / 5)
        + 0.15 * np.maximum(0, 50 - stats["dark_std"])
    )[a:b]
    return (a + int(score.argmax()), float(score.max())) if b > a else (n // 2, float("-inf"))


def text_at(stats: dict[str, np.ndarray], at: int, around: int = 3) -> tuple[bool, float]:
    """Whether text crosses the split, and how sure that is: two of three signs in a narrow window."""
    w = slice(max(0, at - around), at + around + 1)
    signs = [
        stats["transitions"][at] > 30 and stats["transitions"][w].mean() > 40,
        stats["dark_run"][at] < 40 and stats["dark_run"][w].mean() < 50,
        stats["dark_std"][w].mean() > 30,
    ]
    n = sum(bool(s) for s in signs)
    return n >= 2, n / 3 if n >= 2 else 1 - n / 3


SPLIT = "struct<two_pages:boolean,confidence:string,position:int,text_at_split:boolean,score:double>"


def detect(pixels: bytes | None, width: int, height: int) -> dict | None:
    """Split of one scan (grey bytes): position from 0 to 1000. Null or wrongly sized images give null."""
    if pixels is None or not width or not height or len(pixels) != width * height:
        return None
    aspect = width / height
    if aspect < 0.9:
        return {"two_pages": False, "confidence": "high", "position": 500, "text_at_split": False, "score": 0.0}
    stats = column_stats(np.frombuffer(pixels, dtype=np.uint8).reshape(height, width))
    at, score = gutter(stats)
    text, _ = text_at(stats, at)
    sure = "high" if aspect > 1.1 and score > 50 and not text else "low" if aspect < 1.0 or score < 30 or text else "medium"
    return {"two_pages": aspect > 1.0, "confidence": sure, "position": int(at / width * 1000 + 0.5), "text_at_split": text, "score": score}


@vectorized(SPLIT)
def detect_split(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    none = dict.fromkeys(("two_pages", "confidence", "position", "text_at_split", "score"))
    return pd.DataFrame([detect(p, int(w), int(h)) or none for p, w, h in zip(pixels, width, height)], columns=list(none))


#: Features of the linear model: name -> (centre, scale, value if missing).
MODEL = {
    "center_darkest": (50.0, 1.0, 50.0), "center_brightest": (50.0, 1.0, 50.0), "edge_center_diff": (0.0, 50.0, 0.0), "inverted_gutter": (0.0, 1.0, 0.0),
    "aspect_ratio": (1.5, 1.0, 1.5), "page_position": (0.5, 1.0, 0.5), "text_gap_center": (500.0, 100.0, 500.0), "book_size": (1.0, 1.0, 1.0),
    "ideal_split": (500.0, 100.0, 500.0), "left_text_end": (500.0, 100.0, 500.0), "right_text_start": (500.0, 100.0, 500.0), "margin_balance": (0.0, 10.0, 0.0),
}


def features(pixels: np.ndarray) -> dict[str, float]:
    """Features of a spread for the model, from its column statistics."""
    height, width = pixels.shape
    stats = column_stats(pixels)
    p10, busy = stats["p10"], stats["transitions"] > 20
    a, b = int(width * 0.4), int(width * 0.6)
    center = p10[a:b]
    edge = max(1, int(width * 0.05))
    around = max(3, int(width * 0.01))
    count = np.convolve(busy, np.ones(2 * around + 1), "same")
    text = count > around
    mid = width // 2
    first = lambda idx, default: int(idx[0]) if len(idx) else default
    left_start = first(np.flatnonzero(text[:mid]), 0)
    left_end = first(np.flatnonzero(text[left_start : mid + 1])[::-1] + left_start, mid)
    right_end = first(np.flatnonzero(text[mid + 1 :])[::-1] + mid + 1, width - 1)
    right_start = first(np.flatnonzero(text[mid : right_end + 1]) + mid, mid)
    gap = (left_end + right_start) / 2
    left, right = left_start, width - 1 - right_end
    diff = center[len(center) // 2] - (p10[:edge].mean() + p10[-edge:].mean()) / 2
    return {
        "center_darkest": float(center.argmin()), "center_brightest": float(center.argmax()), "edge_center_diff": float(diff), "inverted_gutter": float(diff > 30),
        "aspect_ratio": width / height, "text_gap_center": gap / width * 1000, "ideal_split": (gap + (left - right) / 2) / width * 1000,
        "left_text_end": left_end / width * 1000, "right_text_start": right_start / width * 1000, "margin_balance": (left - right) / width * 100,
    }


def train(examples: DataFrame, target: str, most: int = 10_000, rate: float = 1e-4, epochs: int = 500) -> dict[str, float]:
    """Weights by gradient descent with clipped gradients, from a bounded sample of `most` examples (the
    first by hash of all columns). Rows with a null or NaN target or feature of the first three are out."""
    need = ["center_darkest", "center_brightest", "edge_center_diff", "aspect_ratio", target]
    ok = F.lit(True)
    for c in need:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    have = [c for c in MODEL if c in examples.columns]
    rows = examples.where(ok).select(*have, target).orderBy(F.xxhash64(*have, target)).limit(most).toPandas()
    if len(rows) < 10:
        raise ValueError(f"at least 10 valid examples are needed, there are {len(rows)}")
    x = np.column_stack([((rows[c].astype(float).fillna(d) if c in have else pd.Series(d, rows.index)) - m) / s for c, (m, s, d) in MODEL.items()])
    y = rows[target].to_numpy(float)
    n = int(len(rows) * 0.8)
    bias, w = float(np.sort(y)[len(y) // 2]), np.zeros(len(MODEL))
    for _ in range(epochs):
        error = bias + x[:n] @ w - y[:n]
        bias -= rate * np.clip(error, -10, 10).mean()
        w -= rate * np.clip(error[:, None] * x[:n], -10, 10).mean(axis=0)
    rest = bias + x[n:] @ w - y[n:]
    return {"bias": bias, **dict(zip(MODEL, w.tolist())), "validation_mse": float((rest**2).mean()) if len(rest) else 0.0}


def predict(weights: dict[str, float], columns: list[str]) -> Column:
    """The model as a column expression, clamped to 200..800; missing features count as their centre."""
    out = F.lit(weights["bias"])
    for c, (m, s, d) in MODEL.items():
        if c in columns:
            out = out + weights[c] * (F.coalesce(F.col(c).cast("double"), F.lit(d)) - m) / s
    return F.greatest(F.lit(200), F.least(F.lit(800), F.floor(out + 0.5))).cast("int")

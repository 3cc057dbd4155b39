"""Measures of text recognition: alignments, ratios, reading order, exact binomial bounds, threshold search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole within 0..1; ``empty`` where the whole is zero."""
    return F.when(whole == 0, F.lit(empty)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), part / whole)))


def align(ref: list[str], out: list[str]) -> tuple[int, int, int, int]:
    """(matches, substitutions, omissions, additions) of the cheapest alignment; ties prefer a match, then a
    substitution, an omission, an addition. The rows carry the counts along, so memory is two rows."""
    prev = [(j, 0, 0, 0, j) for j in range(len(out) + 1)]  # cost, matches, substitutions, omissions, additions
    for i, r in enumerate(ref, 1):
        cur = [(i, 0, 0, i, 0)]
        for j, o in enumerate(out, 1):
            c, m, s, om, ad = prev[j - 1]
            best = (c, m + 1, s, om, ad) if r == o else (c + 1, m, s + 1, om, ad)
            c, m, s, om, ad = prev[j]
            if c + 1 < best[0]:
                best = (c + 1, m, s, om + 1, ad)
            c, m, s, om, ad = cur[-1]
            if c + 1 < best[0]:
                best = (c + 1, m, s, om, ad + 1)
            cur.append(best)
        prev = cur
    return prev[-1][1:]


def common_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[-1]))
        prev = cur
    return prev[-1]


def token_alignment(df: DataFrame, key: str, ref: str, out: str) -> DataFrame:
    """(key, matches, substitutions, omissions, additions, in_order) of two token arrays per row."""
    kind = df.schema[key].dataType.simpleString()
    cols = ["matches", "substitutions", "omissions", "additions", "in_order"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *align(list(r), list(o)), common_order(list(r), list(o))) for k, r, o in zip(pdf[key], pdf[ref], pdf[out])]
            yield pd.DataFrame(rows, columns=[key, *cols]).astype({c: "int32" for c in cols})

    return df.select(key, ref, out).mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"{c} int" for c in cols))


_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction; arrays of one length, 0 < x < 1."""
    turn = x > (a + 1) / (a + b + 2)  # the fraction converges fast below the mean
    y, p, q = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    deep = 100 + 4 * math.ceil(math.sqrt(float(np.max(p + q))))  # terms that matter grow with the root of the parameters
    below = np.ones_like(y)
    for j in range(deep, 0, -1):
        m = j // 2
        term = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)) if j % 2 else m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        below = 1 + term / below
    out = front / below
    return np.where(turn, 1 - out, out)


def beta_quantile(share: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with I_x(a, b) = share: Newton's steps inside a bracket that every step narrows."""
    low, high, x = np.zeros_like(a), np.ones_like(a), a / (a + b)
    norm = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
    for _ in range(200):
        off = beta_share(x, a, b) - share
        low, high = np.where(off < 0, x, low), np.where(off < 0, high, x)
        slope = np.exp(norm + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
        new = x - off / np.maximum(slope, 1e-300)
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        done = np.abs(new - x) < 1e-13
        x = new
        if np.all(done):
            break
    return x


def upper_bounds(k: np.ndarray, n: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    """Exact one-sided upper bounds of rates with k cases of n: quantiles of Beta(k + 1, n - k); 1 without observations or when all are cases."""
    k, n = np.asarray(k, dtype=float), np.asarray(n, dtype=float)
    out = np.ones(len(k))
    open_ = (n > 0) & (k < n)
    if open_.any():
        pairs, back = np.unique(np.stack([k[open_], n[open_]]), axis=1, return_inverse=True)
        out[open_] = beta_quantile(1 - alpha, pairs[0] + 1, pairs[1] - pairs[0])[back.ravel()]
    return out


def bound_column(k: Column | str, n: Column | str, alpha: float = 0.05) -> Column:
    """:func:`upper_bounds` as a column."""

    def run(ks: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series(upper_bounds(ks.to_numpy(), ns.to_numpy(), alpha))

    return F.pandas_udf(run, T.DoubleType())(k, n)


def tile_offsets(length: int, tile: int, overlap: int) -> list[int]:
    """Starts of tiles that cover a length; the last one ends with it."""
    if length <= tile:
        return [0]
    step = tile - overlap
    out = list(range(0, length - tile, step))
    return out + [length - tile]

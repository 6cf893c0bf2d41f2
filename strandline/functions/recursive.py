"""Features that feed on their own last value: no window frame expresses them, so each symbol's history is one grouped map.

A group is one symbol in time order; kernels are numpy over its arrays, handed over by Arrow.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Kernel = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def ewm(x: np.ndarray, alpha: float, start: float | None = None) -> np.ndarray:
    """y[0] = x[0] (or ``start``), y[i] = alpha x[i] + (1 - alpha) y[i - 1]; a missing x keeps the last y."""
    out = np.empty(len(x))
    y = np.nan if start is None else start
    for i, v in enumerate(x.tolist()):
        if v == v:
            y = v if y != y else alpha * v + (1 - alpha) * y
        out[i] = y
    return out


def ema(x: np.ndarray, span: int) -> np.ndarray:
    return ewm(x, 2.0 / (span + 1))


def macd(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = ema(x, fast) - ema(x, slow)
    smooth = ema(line, signal)
    return line, smooth, line - smooth


def rsi_wilder(x: np.ndarray, n: int = 14) -> np.ndarray:
    """Wilder's index: plain means of the first ``n`` changes, then smoothed by 1 / n; NaN before."""
    out = np.full(len(x), np.nan)
    if len(x) <= n:
        return out
    d = np.diff(x)
    up, down = np.maximum(d, 0), np.maximum(-d, 0)
    a, b = ewm(up[n:], 1 / n, up[:n].mean()), ewm(down[n:], 1 / n, down[:n].mean())
    a, b = np.append(up[:n].mean(), a), np.append(down[:n].mean(), b)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[n:] = np.where(b == 0, 100.0, 100 - 100 / (1 + a / b))
    return out


def band(x: np.ndarray, width: float) -> np.ndarray:
    """A position held until the target is further than ``width`` away, then the target."""
    out = np.empty(len(x))
    held = 0.0
    for i, v in enumerate(x.tolist()):
        if v == v and abs(v - held) > width:
            held = v
        out[i] = held
    return out


def hold(x: np.ndarray, least: int) -> np.ndarray:
    """A position kept for ``least`` bars at least after each change."""
    out = np.empty(len(x))
    held, since = 0.0, least
    for i, v in enumerate(x.tolist()):
        if v == v and v != held and since >= least:
            held, since = v, 0
        since += 1
        out[i] = held
    return out


def per_group(rows: DataFrame, keys: list[str], order: str, kernel: Kernel, made: dict[str, str]) -> DataFrame:
    """``rows`` with the columns that ``kernel`` makes of each key's columns in ``order``. made: name to type.

    NaN in a made column is null. One key's rows are one task's work, as each value needs the last.
    """
    kept = rows.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{k}` {t}" for k, t in made.items()])

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, sort_keys=[(order, "ascending")]))
        cols = {c: group.column(c).to_numpy(zero_copy_only=False) for c in kept if pa.types.is_primitive(group.schema.field(c).type)}
        out = kernel(cols)
        for c in made:
            v = np.asarray(out[c])
            group = group.append_column(c, pa.array(v, mask=np.isnan(v)) if v.dtype.kind == "f" else pa.array(v))
        return group

    return rows.groupBy(*keys).applyInArrow(run, schema)

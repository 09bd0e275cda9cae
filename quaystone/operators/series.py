"""Indicators as array formulas over the ordered bars of whole symbols: what an Arrow pass computes from a chunk.

A frame of n bars is the sum (or the extreme) of n shifted arrays, oldest first, so that the work of a chunk is a few hundred
array operations instead of one step a row, frame and bar.  Within arrays NaN stands for null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Least rows of a chunk (whole symbols; a symbol has one bar a date).
CHUNK = 50_000


class Series:
    """Columns of one chunk by name, computed when first asked for; ``pos`` is a bar's number within its symbol, from 0."""

    def __init__(self, columns: dict[str, np.ndarray], pos: np.ndarray, formulas=None):
        self.columns, self.pos, self.formulas = dict(columns), pos, FORMULAS | (formulas or {})
        left = np.append(pos[1:], 0)  # bars that follow within the symbol: distance to the next symbol's first
        ends = np.flatnonzero(left == 0)
        self.left = ends[np.searchsorted(ends, np.arange(len(pos)))] - np.arange(len(pos))

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.columns:
            made = self.formulas[name](self)
            self.columns.update(made if isinstance(made, dict) else {name: made})
        return self.columns[name]

    def full(self, x: np.ndarray, n: int) -> np.ndarray:
        """Null where fewer than ``n`` bars are there."""
        return np.where(self.pos >= n - 1, x, np.nan)

    def lag(self, name: str, n: int = 1) -> np.ndarray:
        return np.where(self.pos >= n, shifted(self[name], n), np.nan)

    def lead(self, name: str, n: int) -> np.ndarray:
        return np.where(self.left >= n, shifted(self[name], -n), np.nan)

    def fold(self, name: str, n: int, step=np.add, first: float = 0.0) -> np.ndarray:
        x = self[name]
        out = np.full(len(x), first)
        for k in range(n - 1, -1, -1):
            out = step(out, shifted(x, k))
        return self.full(out, n)

    def mean(self, name: str, n: int) -> np.ndarray:
        return self.fold(name, n) / n

    def lowest(self, name: str, n: int) -> np.ndarray:
        return self.fold(name, n, np.minimum, np.inf)

    def highest(self, name: str, n: int) -> np.ndarray:
        return self.fold(name, n, np.maximum, -np.inf)

    def ahead(self, name: str, n: int, step, first: float) -> np.ndarray:
        """Extreme of the next ``n`` bars."""
        x = self[name]
        out = np.full(len(x), first)
        for k in range(1, n + 1):
            out = step(out, shifted(x, -k))
        return np.where(self.left >= n, out, np.nan)

    def deviation(self, name: str, n: int) -> np.ndarray:
        """Sample deviation, by running mean and squares."""
        x = self[name]
        mean, squares = np.zeros(len(x)), np.zeros(len(x))
        for i in range(1, n + 1):
            delta = shifted(x, n - i) - mean
            part = delta / i
            mean = mean + part
            squares = squares + delta * (delta - part)
        return self.full(np.sqrt(squares / (n - 1.0)), n)


def shifted(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` moved by ``n`` places; places without a value are NaN."""
    out = np.full(len(x), np.nan)
    if n >= 0:
        out[n:] = x[: len(x) - n] if n < len(x) else out[n:]
    else:
        out[:n] = x[-n:] if -n < len(x) else out[:n]
    return out


def div(a, b) -> np.ndarray:
    """Null where ``b`` is 0 or the quotient is not finite."""
    out = a / b
    return np.where((b == 0) | ~np.isfinite(out), np.nan, out)


def filled(x: np.ndarray, value: float) -> np.ndarray:
    return np.where(np.isnan(x), value, x)


def clip(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bounded; null becomes ``low``."""
    return np.fmin(np.fmax(x, low), high)


def _gain_loss(f: Series) -> dict:
    step = filled(f["close"] - f.lag("close"), 0.0)
    return {"_gain": np.maximum(step, 0.0), "_loss": np.maximum(-step, 0.0)}


def rsi(f: Series, n: int = 14) -> np.ndarray:
    """Simple rolling means of gains and losses; the first row counts as no move."""
    g, low = f.mean("_gain", n), f.mean("_loss", n)
    value = np.where((low == 0) & (g > 0), 100.0, 100 - 100 / (1 + np.where(low == 0, np.nan, g / low)))
    return np.where((low == 0) & (g == 0), np.nan, value)


def _mean_step(mean, gap, x, alpha: float):
    """Exponential means and the bars since their last values, moved on by ``x``; a missing value keeps a mean and ages it."""
    known, old = ~np.isnan(x), (1 - alpha) ** gap
    moved = np.where(np.isnan(mean), x, (old * mean + alpha * x) / (old + alpha))
    return np.where(known, moved, mean), np.where(known, 1, gap + 1)


def recursive(f: Series) -> dict:
    """MACD(12,26,9) and KDJ(9,3,3): bar by bar for all symbols of the chunk at once, as their means are recursive."""
    close = f["close"]
    low, high = f.lowest("low", 9), f.highest("high", 9)
    rsv = np.where(high == low, np.nan, (close - low) / (high - low)) * 100
    names = ("macd", "macd_signal", "macd_hist", "kdj_k", "kdj_d", "kdj_j")
    out = {n: np.full(len(close), np.nan) for n in names}
    starts = np.flatnonzero(f.pos == 0)
    length = f.left[starts] + 1
    starts = starts[np.argsort(-length, kind="stable")]
    length = np.sort(length)[::-1]
    longest = int(length[0]) if len(length) else 0
    running = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")  # symbols that have a bar of this number
    third, kept = 1.0 / 3, 2.0 / 3  # steps are written as in the SQL, so that ties (k = d, j = 100) fall alike
    powers = np.array([kept**k for k in range(longest + 2)])
    gaps = bool(np.isnan(close).any())
    e12 = e26 = sig = k = d = np.full(len(starts), np.nan)
    n12 = n26 = nk = np.ones(len(starts), dtype=np.int64)
    for t in range(longest):
        m = running[t]
        at = starts[:m] + t
        x, r = close[at], rsv[at]
        e12, e26, sig, k, d, nk = e12[:m], e26[:m], sig[:m], k[:m], d[:m], nk[:m]
        if gaps:
            n12, n26 = n12[:m], n26[:m]
            simple = (n12 == 1) & ~np.isnan(e12) & ~np.isnan(x)
            (a, n12), (b, n26) = _mean_step(e12, n12, x, 2 / 13), _mean_step(e26, n26, x, 2 / 27)
            e12, e26 = np.where(simple, e12 + (x - e12) * 2 / 13, a), np.where(simple, e26 + (x - e26) * 2 / 27, b)
        elif t == 0:
            e12 = e26 = x
        else:
            e12, e26 = e12 + (x - e12) * 2 / 13, e26 + (x - e26) * 2 / 27
        macd = e12 - e26
        sig = np.where(np.isnan(sig), macd, sig + (macd - sig) * 0.2)
        known = ~np.isnan(r)
        old = powers[nk]
        k = np.where(known, np.where(np.isnan(k), r, (old * k + r / 3) / (old + third)), k)
        nk = np.where(known, 1, nk + 1)
        d = np.where(np.isnan(d), k, d * 2 / 3 + k / 3)
        for n, v in zip(names, (macd, sig, macd - sig, k, d, 3 * k - 2 * d), strict=True):
            out[n][at] = v
    return out


def _ratio(name: str, n: int):
    return lambda f: div(f[name], f.mean(name, n))


def _gap(name: str):
    return lambda f: filled(div(f["close"], f[name]) - 1, 0.0) * 100


def _return(n: int):
    return lambda f: filled(div(f["close"], f.lag("close", n)) - 1, 0.0) * 100


def forward(horizon: int) -> dict:
    """Formulas of the next ``horizon`` bars: return, greatest gain and worst low against the close; null where they are not all there."""
    worst = lambda f: f.ahead("low", horizon, np.minimum, np.inf)
    return {
        "future_return": lambda f: div(f.lead("close", horizon), f["close"]) - 1,
        "future_max_gain": lambda f: div(np.where(np.isnan(worst(f)), np.nan, f.ahead("high", horizon, np.fmax, -np.inf)), f["close"]) - 1,
        "future_max_drawdown": lambda f: div(worst(f), f["close"]) - 1,
    }


FORMULAS = {
    "n_bars": lambda f: (f.pos + f.left + 1).astype(np.int32),
    **{f"ma{n}": (lambda n: lambda f: f.mean("close", n))(n) for n in (5, 10, 20, 60)},
    "_dev": lambda f: f.deviation("close", 20), "boll_mid": lambda f: f["ma20"],
    "boll_upper": lambda f: f["ma20"] + 2.0 * f["_dev"], "boll_lower": lambda f: f["ma20"] - 2.0 * f["_dev"],
    "_gain": _gain_loss, "_loss": _gain_loss, "rsi": rsi,
    **dict.fromkeys(("macd", "macd_signal", "macd_hist", "kdj_k", "kdj_d", "kdj_j"), recursive),
    "_daily": lambda f: div(f["close"], f.lag("close")) - 1, "pct_change": lambda f: filled(f["_daily"], 0.0) * 100,
    "amount_yi": lambda f: np.where(np.isnan(f["amount"]), f["close"] * f["volume"], f["amount"]) / 1e8,
    "return_5d": _return(5), "return_20d": _return(20), "prev_pct_change": lambda f: filled(f.lag("pct_change"), 0.0),
    "ma20_gap_pct": _gap("ma20"), "ma60_gap_pct": _gap("ma60"),
    "ma_alignment": lambda f: sum((f[a] >= f[b]).astype(np.int32) for a, b in (("close", "ma5"), ("ma5", "ma10"), ("ma10", "ma20"), ("ma20", "ma60"))),
    "boll_position": lambda f: filled(div(f["close"] - f["boll_lower"], f["boll_upper"] - f["boll_lower"]), 0.5),
    "volume_ratio_5": lambda f: clip(_ratio("volume", 5)(f), 0.0, 8.0), "volume_ratio_20": lambda f: clip(_ratio("volume", 20)(f), 0.0, 8.0),
    "turnover_inferred": lambda f: clip(filled(_ratio("amount_yi", 20)(f), 1.0), 0.1, 10.0) * 3,
    "money_flow_proxy": lambda f: clip(f["amount_yi"] * f["pct_change"] / 12, -5.0, 5.0),
    "volatility_20d": lambda f: filled(f.deviation("_daily", 20) * np.sqrt(252.0) * 100, 0.0),
    "from_20d_high_pct": lambda f: filled(div(f["close"], f.highest("high", 20)) - 1, 0.0) * 100,
    "from_20d_low_pct": lambda f: filled(div(f["close"], f.lowest("low", 20)) - 1, 0.0) * 100,
    "intraday_range_pct": lambda f: filled(div(f["high"] - f["low"], f["close"]), 0.0) * 100,
}


def chunks(batches):
    """Batches in order of symbol and date, ``_k`` 1 at a symbol's first bar, put together to whole symbols of at least ``CHUNK`` rows in all."""
    held, rows = [], 0
    for batch in batches:
        cut = 0
        if rows + batch.num_rows >= CHUNK:
            firsts = np.flatnonzero(batch.column("_k").to_numpy() == 1)
            cut = int(firsts[-1]) if len(firsts) else 0
            if (rows + cut) and len(firsts):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
                held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded half away from zero as ``plans.sqltext.r`` does, with its hair for ties (numbers below 1e10; beyond, the last digit of a double is at stake); -0 becomes 0."""
    x, scale = x + 1e-9, 10.0**digits
    return np.where(np.abs(x) * scale < 2.0**52, np.copysign(np.floor(np.abs(x) * scale + 0.5), x) / scale, x) + 0.0


def columns_pass(inputs: list[str], kept: list[str], made: list[str], formulas=None, where=None, whole=False, digits=None):
    """The pass over batches that adds the columns ``made``, computed from ``inputs``, to the columns ``kept``.

    ``where`` names a formula of the rows that stay; ``whole``: all made columns are doubles in which null and non-finite numbers
    are 0, rounded to ``digits`` if given.
    """

    def finished(x, at):
        x = x if at is None else x[at]
        if not whole:
            return pa.array(x, from_pandas=True)
        x = np.where(np.isfinite(x), x, 0.0)
        return pa.array(x if digits is None else rounded(x, digits))

    def run(batches):
        with np.errstate(all="ignore"):
            for table in chunks(batches):
                numbers = {c: table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in inputs}
                f = Series(numbers, table.column("_k").to_numpy().astype(np.int64) - 1, formulas)
                at = np.flatnonzero(f[where]) if where else None
                old = table.select(kept) if at is None else table.select(kept).take(at)
                yield from pa.table([*old.columns, *(finished(f[c], at) for c in made)], names=[*kept, *made]).to_batches(max_chunksize=10_000)

    return run

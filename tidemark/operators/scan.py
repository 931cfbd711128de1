"""The breakout scan of one symbol, folded over its sorted arrays: level, base, patterns, score and plan in one pass.

Each part means what the operator of its name in screen.py means; those work over all symbols at once and are asked for singly. A scan asks
for all of them, and a symbol's arrays, a few thousand days at most, then serve all parts without being brought together again.
"""

from __future__ import annotations

import datetime as dt

import numpy as np

#: Columns of the result, in order.
SCAN_COLUMNS = {
    "n": "long", "ma50": "double", "close": "double", "calm": "boolean", "level": "double", "touches": "long", "base_days": "long", "distance": "double", "last_close": "double", "last_date": "date", "base_start": "date",
    "m": "long", "base_low": "double", "recent_low": "double", "base_quality": "double", "vcr": "double", "vdu": "double", "proximity": "double", "trend": "double", "rs": "double", "high52": "double", "score": "double",
    "stop": "double", "target": "double", "rr": "double", "risk_pct": "double", "rs_rising": "boolean", "failed_breakout": "boolean", "recent_touches": "long", "range_pct": "double", "trailing_pct": "double", "is_flat": "boolean",
    "cup_handle": "boolean", "n_vcp": "long", "w_pattern": "boolean",
}


def rolling_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Means of the last n values; NaN where there are fewer or one is NaN."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n).mean(axis=1)
    return out


def extremes(x: np.ndarray, k: int, best) -> np.ndarray:
    """Places whose value is the best (np.max, np.min) of k places on both sides, all of which are there."""
    if len(x) < 2 * k + 1:
        return np.zeros(0, int)
    return np.flatnonzero(x[k:-k] == best(np.lib.stride_tricks.sliding_window_view(x, 2 * k + 1), axis=1)) + k


def slope(y: np.ndarray, x: np.ndarray | None = None) -> float:
    """Least-squares slope; NaN without two different x."""
    x = np.arange(len(y), dtype=float) if x is None else x.astype(float)
    if len(y) < 2:
        return np.nan
    x = x - x.mean()
    spread = (x * x).sum()
    return float((x * (y - y.mean())).sum() / spread) if spread else np.nan


def recent_slope(values: np.ndarray, n: int, least: int = 5) -> float | None:
    """Slope of the newest n known values: 0 with fewer than `least`, None without any."""
    known = values[~np.isnan(values)][-n:]
    return None if not len(known) else 0.0 if len(known) < least else slope(known)


def true_ranges(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    out = high - low
    out[1:] = np.maximum(out[1:], np.maximum(np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])))
    return out


def best_level(days: np.ndarray, high: np.ndarray, close: float, n: int, p: dict) -> tuple | None:
    """(touches, base days, -|distance|, level, distance) of the level that counts, or None."""
    if n < p["base_min_days"] + 20:
        return None
    tops = np.union1d(extremes(high, 3, np.max), extremes(high, 8, np.max))
    prices, ages = high[tops], days[-1] - days[tops]
    runs: list[list] = []
    for v in np.sort(prices)[::-1].tolist():
        if runs and abs(v - runs[-1][0] / runs[-1][1]) / (runs[-1][0] / runs[-1][1]) <= p["band"]:
            runs[-1][0] += v
            runs[-1][1] += 1
        else:
            runs.append([v, 1])
    found = []
    for total, size in runs:
        level = total / size
        near = ages[np.abs(prices - level) / level <= p["band"]]
        young = near[near <= p["base_max_days"]]
        distance = (level - close) / close if close else np.nan
        if size < p["min_touches"] or len(near) < p["min_touches"] or not p["near_low"] <= distance <= p["near_high"] or near.max() < p["base_min_days"]:
            continue
        base = int(near.max()) if near.max() <= p["base_max_days"] else int(young.max()) if len(young) >= p["min_touches"] else None
        if base is not None:
            found.append((len(near), base, -abs(distance), level, distance))
    if not found:
        return None
    best = max(found)
    above = [c for c in found if c[3] > best[3] * 1.02 and c[0] >= max(2, best[0] * 8 // 10) and c[1] >= best[1] * 8 // 10]
    return max(above, key=lambda c: c[3]) if above else best


def has_cup_and_handle(high: np.ndarray, low: np.ndarray, level: float, close: float) -> bool:
    size = len(high) - 5
    if len(high) < 50:
        return False
    third = max(size // 3, 1)
    top, bottom = high[:size].max(), low[:size].min()
    depth = (top - bottom) / top if top else np.nan
    return bool(0.12 <= depth <= 0.40 and low[third : min(2 * third, size)].min() <= bottom * 1.05 and (top - low[-15:].min()) / top <= depth * 0.5 and abs(level - close) / close <= 0.08)


def contractions(high: np.ndarray, low: np.ndarray, k: int = 5) -> int:
    """Pullbacks from one high pivot to the next that are under 85 % of the one before and under 15 %."""
    if len(high) < 30:
        return 0
    tops = extremes(high, k, np.max)
    pulls = [(high[a] - low[a : b + 1].min()) / high[a] for a, b in zip(tops[:-1], tops[1:], strict=True)]
    return sum(b < a * 0.85 and b < 0.15 for a, b in zip(pulls[:-1], pulls[1:], strict=True))


def has_double_bottom(high: np.ndarray, low: np.ndarray, near: bool, close: float, k: int = 4) -> bool:
    """Two swing lows within 4 %, five or more bars apart, a peak of 5 % or more between, the close back near the peak or the level.

    From each low the peaks up to all later lows are running maxima, so a low is compared with the others at once.
    """
    if len(low) < 25:
        return False
    lows = extremes(low, k, np.min)
    for at in lows:
        later = lows[lows - at >= 5]
        if len(later):
            peak = np.maximum.accumulate(high[at + 1 :])[later - at - 2]
            bottom, other = np.minimum(low[at], low[later]), np.maximum(low[at], low[later])
            if (((other - bottom) / bottom <= 0.04) & ((peak - bottom) / bottom >= 0.05) & ((close >= peak * 0.97) | near)).any():
                return True
    return False


def scan_symbol(days: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray, bench: np.ndarray, exact: np.ndarray, p: dict) -> dict:
    """What SCAN_COLUMNS name, of one symbol's rows by date; bench is the benchmark's last value at each date, exact where it is that date's own."""
    n, now = len(close), float(close[-1])
    ma50, ma200, atr20 = rolling_mean(close, 50), rolling_mean(close, 200), rolling_mean(true_ranges(high, low, close), 20)
    steps = np.abs(close[1:] / close[:-1] - 1)[-5:]
    calm = n >= 25 and not (steps > 0.05).any() and (np.isnan(atr20[-1]) or atr20[-1] <= 0 or high[-1] - low[-1] <= atr20[-1] * 2.5)
    out: dict = {"n": n, "ma50": _known(ma50[-1]), "close": now, "calm": bool(calm)}
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(bench != 0, close / bench, np.nan)
    own = ratio[exact & ~np.isnan(ratio)]
    rising = recent_slope(own, 50)
    if rising is not None:
        out["rs_rising"] = bool(rising > 0 and len(own) >= 50)
    found = best_level(days[-p["lookback"] :], high[-p["lookback"] :], now, n, p)
    if found is None:
        return out
    touches, base_days, _, level, distance = found
    start = int(days[-1]) - base_days
    at = int(np.searchsorted(days, start))
    bh, bl, m = high[at:], low[at:], n - at
    near = p["near_low"] <= distance <= p["near_high"]
    day = lambda d: dt.date(1970, 1, 1) + dt.timedelta(days=int(d))
    trailing = float(bh[-25:].max() - bl[-25:].min()) / level
    out |= dict(level=level, touches=touches, base_days=base_days, distance=distance, last_close=now, last_date=day(days[-1]), base_start=day(start), m=m, base_low=float(bl.min()), recent_low=float(bl[-20:].min()))
    out |= dict(range_pct=float(bh.max() - bl.min()) / level, trailing_pct=trailing, is_flat=trailing <= 0.10, failed_breakout=bool((high[-15:] > level * 1.03).any() and now < level * 0.98))
    out["recent_touches"] = int((high[-p["test_bars"] :] >= level * (1 - p["test_band"])).sum()) if n >= 60 else 0
    out |= dict(cup_handle=has_cup_and_handle(bh, bl, level, now), n_vcp=contractions(bh, bl), w_pattern=has_double_bottom(bh, bl, near, now))
    out |= score_parts(out, high, low, close, volume, ratio, ma50, ma200, at, p)
    risk = now - out["recent_low"] * 0.99
    target = level * 2 - out["base_low"]
    return out | dict(stop=out["recent_low"] * 0.99, target=target, rr=(target - now) / risk if risk > 0 else None, risk_pct=risk / now * 100 if now else None)


def score_parts(s: dict, high, low, close, volume, ratio, ma50, ma200, at: int, p: dict) -> dict:
    """The seven parts of the score and their sum."""
    now, m, atr14 = s["last_close"], s["m"], rolling_mean(true_ranges(high, low, close), 14)
    unit = lambda v: max(min(v, 1.0), 0.0)
    mean = lambda x: float(np.nanmean(x)) if len(x) and not np.isnan(x).all() else np.nan
    share = lambda a, b: 0.0 if np.isnan(a) or np.isnan(b) or not b else 1 - a / b
    rise50, rise200 = (recent_slope(x, 20) or 0.0 for x in (ma50, ma200))
    swings = extremes(low[at:], 5, np.min)
    climbing = len(swings) >= 3 and slope(low[at:][swings], swings) > 0
    touches = 1.0 if s["touches"] >= 5 else min(0.75 + 0.075 * (s["touches"] - 2), 1.0)
    quality = 25.0 * min(s["base_days"] / 120, 1.0) * touches
    if climbing and len(swings) >= 5:
        quality = min(quality * 1.15, 25.0)
    if now > ma50[-1] > ma200[-1] and rise50 > 0 and 30 <= s["base_days"] <= 99:
        quality = max(quality, 16.0)
    strength, known = 0.0, ratio[~np.isnan(ratio)]
    if len(known) >= 60:
        sums = np.concatenate([[0.0], np.cumsum(known)])
        size = np.minimum(np.arange(1, len(known) + 1), 252)
        mansfield = (known / ((sums[1:] - sums[np.arange(1, len(known) + 1) - size]) / size) - 1) * 100
        strength = 5.0 * (mansfield[-1] > 0) + 5.0 * ((recent_slope(mansfield, 20) or 0.0) > 0)
    top = float(high[-252:].max())
    parts = dict(
        base_quality=quality,
        vcr=10.0 * unit(share(mean(atr14[-10:]), mean(atr14[at : at + 20])) / 0.30),
        vdu=5.0 * unit(share(mean(volume[-10:]), mean(volume[-50:])) / 0.20),
        proximity=20.0 * max(0.0, 1 - abs(s["distance"]) / p["near_high"]) if p["near_low"] <= s["distance"] <= p["near_high"] else 0.0,
        trend=5.0 * (now > ma50[-1]) + 5.0 * (now > ma200[-1]) + 5.0 * (rise50 > 0 and rise200 > 0),
        rs=strength,
        high52=15.0 * unit(1 - (top - now) / top / 0.15) if top else 0.0,
    )
    return parts | {"score": sum(parts.values()) if m >= 20 else 0.0}


def _known(x: float) -> float | None:
    return None if np.isnan(x) else float(x)

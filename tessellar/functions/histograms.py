"""Arithmetic of native histograms, as dictionaries with the fields of model.HIST. Nothing here changes its arguments."""

from __future__ import annotations

import math

from ..model import GAUGE, NOT_RESET, RESET

Hist = dict


def custom(count: float, total: float | None, bounds: list[float], counts: list[float]) -> Hist:
    return {"exp": False, "count": count, "sum": total, "bounds": list(bounds), "counts": list(counts), "scale": None, "zero_threshold": None, "zero_count": None, "pos": None, "neg": None}


def exponential(count: float, total: float | None, scale: int, threshold: float, zeros: float, pos: dict[int, float], neg: dict[int, float]) -> Hist:
    listed = lambda d: [{"idx": i, "cnt": float(c)} for i, c in sorted(d.items()) if c != 0]
    return {"exp": True, "count": count, "sum": total, "bounds": None, "counts": None, "scale": scale, "zero_threshold": threshold, "zero_count": zeros, "pos": listed(pos), "neg": listed(neg)}


def _side(h: Hist, side: str, scale: int | None = None) -> dict[int, float]:
    """A side's buckets, at a coarser scale if one is given: indices are floor-divided."""
    down = 0 if scale is None else h["scale"] - scale
    out: dict[int, float] = {}
    for b in h[side] or []:
        out[b["idx"] >> down] = out.get(b["idx"] >> down, 0.0) + b["cnt"]
    return out


def downscale(h: Hist, scale: int) -> Hist:
    if scale > h["scale"]:
        raise ValueError("a histogram can only become coarser")
    return exponential(h["count"], h["sum"], scale, h["zero_threshold"], h["zero_count"], _side(h, "pos", scale), _side(h, "neg", scale))


def coarsen(h: Hist, bounds: list[float]) -> Hist:
    """A histogram with explicit bounds at a subset of them."""
    out, at = [], 0
    for b in bounds:
        k = h["bounds"].index(b) + 1
        out.append(sum(h["counts"][at:k]))
        at = k
    return custom(h["count"], h["sum"], bounds, [*out, sum(h["counts"][at:])])


def align(hs: list[Hist]) -> list[Hist] | None:
    """All in one layout: the bounds that all have, or the least scale. None if kinds or zero thresholds differ."""
    if len({h["exp"] for h in hs}) != 1:
        return None
    if hs[0]["exp"]:
        if len({h["zero_threshold"] for h in hs}) != 1:
            return None
        scale = min(h["scale"] for h in hs)
        return [downscale(h, scale) for h in hs]
    shared = sorted(set.intersection(*(set(h["bounds"]) for h in hs)))
    return [h if h["bounds"] == shared else coarsen(h, shared) for h in hs]


def parts(h: Hist) -> dict:
    """Its components by name, without the sum."""
    if h["exp"]:
        return {"count": h["count"], "zero": h["zero_count"]} | {("pos", i): c for i, c in _side(h, "pos").items()} | {("neg", i): c for i, c in _side(h, "neg").items()}
    return {"count": h["count"]} | {("at", i): c for i, c in enumerate(h["counts"])}


def rebuilt(like: Hist, p: dict, total: float | None) -> Hist:
    if like["exp"]:
        side = lambda s: {k[1]: c for k, c in p.items() if k[0] == s}
        return exponential(p["count"], total, like["scale"], like["zero_threshold"], p.get("zero", 0.0), side("pos"), side("neg"))
    return custom(p["count"], total, like["bounds"], [p.get(("at", i), 0.0) for i in range(len(like["bounds"]) + 1)])


def add(a: Hist, b: Hist, sign: float = 1.0) -> Hist | None:
    both = align([a, b])
    if both is None:
        return None
    p, q = parts(both[0]), parts(both[1])
    total = None if a["sum"] is None or b["sum"] is None else a["sum"] + sign * b["sum"]
    return rebuilt(both[0], {k: p.get(k, 0.0) + sign * q.get(k, 0.0) for k in p | q}, total)


def times(h: Hist, s: float) -> Hist:
    return rebuilt(h, {k: c * s for k, c in parts(h).items()}, None if h["sum"] is None else h["sum"] * s)


def over(h: Hist, s: float) -> Hist:
    div = lambda c: c / s if s else (math.nan if c == 0 or math.isnan(c) else math.copysign(math.inf, c) * math.copysign(1, s))
    return rebuilt(h, {k: div(c) for k, c in parts(h).items()}, None if h["sum"] is None else div(h["sum"]))


def _same(a, b) -> bool:
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)


def equal(a: Hist, b: Hist, nan_sums: bool = False) -> bool:
    if a["exp"] != b["exp"] or a["bounds"] != b["bounds"] or a["scale"] != b["scale"] or a["zero_threshold"] != b["zero_threshold"]:
        return False
    sums = _same(a["sum"], b["sum"]) if nan_sums else a["sum"] == b["sum"]
    return sums and parts(a) == parts(b)


def combine(hs: list[Hist], mean: bool = False) -> Hist | None:
    """The sum, or mean, of a group; None if layouts can't be brought together. A sum that any lacks is absent."""
    both = align(hs)
    if both is None:
        return None
    total: dict = {}
    for h in both:
        for k, c in parts(h).items():
            total[k] = total.get(k, 0.0) + c
    out = rebuilt(both[0], total, None if any(h["sum"] is None for h in hs) else sum(h["sum"] for h in hs))
    return times(out, 1.0 / len(hs)) if mean else out


def _spans(h: Hist) -> list[tuple[float, float, float, str]]:
    """(lower, upper, count, kind) of the buckets with counts, in order of value."""
    if not h["exp"]:
        edges = [*h["bounds"], math.inf]
        low = 0.0 if h["bounds"] and h["bounds"][0] > 0 else -math.inf
        return [(low if i == 0 else edges[i - 1], edges[i], c, "line") for i, c in enumerate(h["counts"])]
    edge = lambda i: math.pow(2.0, i * math.pow(2.0, -h["scale"])) if i * math.pow(2.0, -h["scale"]) < 1024 else math.inf
    t = h["zero_threshold"] or 0.0
    neg, pos = _side(h, "neg"), _side(h, "pos")
    out = [(-edge(i + 1), min(-edge(i), -t), c, "neg") for i, c in sorted(neg.items(), reverse=True) if c]
    if h["zero_count"]:
        out.append((0.0 if pos and not neg else -t, 0.0 if neg and not pos else t, h["zero_count"], "line"))
    return out + [(max(edge(i), t), edge(i + 1), c, "pos") for i, c in sorted(pos.items()) if c]


def _between(low: float, high: float, kind: str, f: float) -> float:
    if kind == "line" or low == 0 or high == 0:
        return low + (high - low) * f
    return low * math.pow(high / low, f)


def quantile(h: Hist, q: float) -> float:
    if h["count"] == 0 or math.isnan(q) or math.isnan(h["count"]):
        return math.nan
    if q < 0 or q > 1:
        return -math.inf if q < 0 else math.inf
    if not h["exp"]:
        return _classic(h, q)
    rank, seen, last = q * h["count"], 0.0, math.nan
    for low, high, c, kind in _spans(h):
        if seen + c >= rank:
            return _between(low, high, kind, (rank - seen) / c)
        seen, last = seen + c, high
    return last


def _classic(h: Hist, q: float) -> float:
    bounds, n = h["bounds"], len(h["counts"])
    if n < 2:
        return math.nan
    cumulative, seen = [], 0.0
    for c in h["counts"]:
        seen += c
        cumulative.append(seen)
    if seen == 0:
        return math.nan
    rank = q * seen
    at = next(i for i, c in enumerate(cumulative) if c >= rank or i == n - 1)
    if at == n - 1:
        return bounds[-1]
    if at == 0 and bounds[0] <= 0:
        return bounds[0]
    start, below = (bounds[at - 1], cumulative[at - 1]) if at else (0.0, 0.0)
    inside = cumulative[at] - below
    return start + (bounds[at] - start) * ((rank - below) / inside if inside else math.nan)


def fraction(h: Hist, low: float, high: float) -> float:
    if h["count"] == 0 or math.isnan(low) or math.isnan(high):
        return math.nan
    if low >= high:
        return 0.0
    if low == -math.inf and high == math.inf:
        return 1.0

    def below(v: float) -> float:
        if v == math.inf:
            return h["count"]
        seen = 0.0
        for a, b, c, kind in _spans(h):
            if v >= b:
                seen += c
            elif v > a:
                if math.isinf(a) or math.isinf(b):
                    f = 0.0
                elif kind == "line" or a == 0 or b == 0:
                    f = (v - a) / (b - a)
                else:
                    f = math.log(v / a) / math.log(b / a)
                return seen + c * f
            else:
                break
        return seen

    return min(1.0, max(0.0, (below(high) - below(low)) / h["count"]))


def _component(values: list[float], hints: list[int]) -> float | None:
    """A counter component's increase; None where a hint forbids what the values do."""
    out, previous = values[-1] - values[0], values[0]
    for v, hint in zip(values[1:], hints[1:], strict=True):
        if hint == GAUGE or hint == NOT_RESET and v < previous:
            return None
        if hint == RESET or v < previous:
            out += previous
        previous = v
    return out


def factor(times_ms: list[int], start: int, end: int, first: float, raw: float) -> float:
    sampled = (times_ms[-1] - times_ms[0]) / 1000.0
    gap = sampled / (len(times_ms) - 1)
    to_start, to_end = (times_ms[0] - start) / 1000.0, (end - times_ms[-1]) / 1000.0
    if to_start >= gap * 1.1:
        to_start = gap / 2.0
    if raw > 0 and first >= 0:
        to_start = min(to_start, sampled * (first / raw))
    if to_end >= gap * 1.1:
        to_end = gap / 2.0
    return (sampled + to_start + to_end) / sampled


def increase(samples: list[dict], start: int, end: int, seconds: float | None) -> Hist | None:
    """rate (seconds given) or increase of a window's samples (ts_ms, hist, reset_hint, start_ms, temporality), in order."""
    delta = {s["temporality"] == "delta" for s in samples}
    if len(delta) != 1:
        return None
    hs = align([s["hist"] for s in samples])
    if hs is None:
        return None
    if delta == {True}:
        if any(s["start_ms"] is None or s["start_ms"] >= s["ts_ms"] for s in samples):
            return None
        whole = combine(hs)
        if len(hs) > 1:  # counts as running totals, extrapolated like a counter; the sum as it is
            grown = combine(hs[1:])
            times_ms = [s["ts_ms"] for s in samples]
            whole = rebuilt(hs[0], {k: c * factor(times_ms, start, end, hs[0]["count"], grown["count"]) for k, c in parts(grown).items()}, whole["sum"])
        return whole if seconds is None else over(whole, seconds)
    times_ms = [s["ts_ms"] for s in samples]
    if len(hs) < 2 or times_ms[-1] <= times_ms[0]:
        return None
    hints = [s["reset_hint"] or 0 for s in samples]
    names = dict.fromkeys(k for h in hs for k in parts(h))
    listed = [parts(h) for h in hs]
    raw = {k: _component([p.get(k, 0.0) for p in listed], hints) for k in names}
    if any(v is None for v in raw.values()):
        return None
    sums = [h["sum"] for h in hs]
    total = None if any(x is None for x in sums) else _component(sums, hints)
    f = factor(times_ms, start, end, hs[0]["count"], raw["count"])
    f = f / seconds if seconds is not None else f
    return rebuilt(hs[0], {k: v * f for k, v in raw.items()}, None if total is None else total * f)


def changes(hs: list[Hist]) -> float:
    return float(sum(not equal(a, b, nan_sums=True) for a, b in zip(hs, hs[1:], strict=False)))


def resets(hs: list[Hist]) -> float | None:
    n = 0
    for a, b in zip(hs, hs[1:], strict=False):
        if a["exp"] != b["exp"]:
            n += 1
            continue
        if a["exp"] and (b["scale"] > a["scale"] or b["zero_threshold"] < a["zero_threshold"]):
            n += 1
            continue
        if a["exp"]:
            scale = min(a["scale"], b["scale"])
            p, q = parts(downscale(a, scale)), parts(downscale(b, scale))
        else:
            both = align([a, b])
            p, q = parts(both[0]), parts(both[1])
        if not all(math.isfinite(x) for x in (*p.values(), *q.values())):
            return None
        n += any(q.get(k, 0.0) < c for k, c in p.items())
    return float(n)

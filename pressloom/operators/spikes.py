"""Implausible readings of a measured series, relative to each source (problem 1).

Method: a hidden Markov model per source with five states (normal, spike, stuck contents, stuck value,
out of range). Forward-backward probabilities assign the states; a reading is flagged where normal is
the less likely explanation. Hard bounds give the out-of-range emission, and take readings whose time is
impossible out of the series.

What a reading emits:

* its count, in spreads of the source about level and rhythm. Normal: a normal density. Spike: even over
  all counts that lie off. Stuck: either, as the count of a stuck source tells nothing;
* how long the contents served before, or the one value, have lasted where it stands. How much longer a
  stretch lasts than the source's usual ones (their 90 % quantile) speaks for a stuck state by a power
  law; no stretch of 24 hours or less, and no reading that opens one, is stuck;
* whether its count is beyond the bounds.

Parameters belong to the source, never to a part of it, and do not depend on how many readings there are:

1. A source's readings are cut into spans of ``SPAN_DAYS`` calendar days, so a hot source is spread over
   tasks. Spans see ``HALO_DAYS`` of their surroundings on either side, more than the level looks at.
2. Each span reports counts of residuals per hour of the week, counts of stretches per length, and its edges.
3. Summed reports (a map-side aggregate; bounded per source) give the rhythm, the spread and the usual
   stretches of the source, and tell each span where a stretch it holds in part began and ends.
4. Each span runs the model on its readings. Steps are composed in blocks as matrices, all blocks at once.

The level is a running median of log counts, so lasting changes of level are normal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.session import cut

SPAN_DAYS, HALO_DAYS = 168, 21
#: The level looks at readings no further away than this; a longer silence ends any stretch.
REACH_DAYS = 10
STATES = ("normal", "spike", "stuck_contents", "stuck_value", "out_of_range")
SCHEMA = "_id long, _p_spike double, _p_stuck double, _state string"
REPORT = "_key string, kind string, slot long, bin long, n long, v array<double>"
FITTED = "_key string, _span long, rhythm array<double>, spread double, usual array<double>, edges array<double>"
DAY = 86_400.0


@dataclass(frozen=True)
class Bounds:
    """Hard bounds: readings of no source can lie beyond them."""

    starts: str = "2026-03-01"
    #: The collection ends before the first gap of more than so many days in which no source was read.
    late_days: int = 365
    #: A feed document of 8 MB, the most that is fetched, has no room for more items.
    max_items: int = 50_000


@dataclass(frozen=True)
class Model:
    stuck_hours: float = 24.0
    #: Stretches so many times as long as the source's usual ones (and half an hour) are as likely stuck as not.
    contents_ratio: float = 3.0
    value_ratio: float = 4.0
    #: Exponent of the power law by which longer stretches speak for a stuck source.
    tail: float = 20.0
    #: Half width, in readings, of the running median.
    half_window: int = 12
    #: Least spread, in logs; and in readings, at the source's level.
    least_spread: float = 0.035
    least_count: float = 0.6
    enter_spike: float = 0.005
    stay_spike: float = 0.15
    enter_stuck: float = 0.02
    leave_stuck: float = 0.1
    enter_range: float = 0.001
    spike_range: float = 8.0
    least_z: float = 3.5
    #: A short run of other counts, at least this far off in logs, does not end a stretch of one value.
    aside: float = 0.35
    aside_readings: int = 3


def running_median(x: np.ndarray, t: np.ndarray, half: int, reach: float) -> np.ndarray:
    """Median of the 2*half+1 readings about each one, none further away than ``reach``; NaN is skipped.

    The series is mirrored at its ends.
    """
    n = len(x)
    half = min(half, max(n - 1, 0))
    if half == 0:
        return x.astype(float)

    def padded(a: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.concatenate([left, a, right])

    px = padded(x, x[1 : half + 1][::-1], x[-half - 1 : -1][::-1])
    pt = padded(t, 2 * t[0] - t[1 : half + 1][::-1], 2 * t[-1] - t[-half - 1 : -1][::-1])
    out = np.empty(n)
    wide = np.lib.stride_tricks.sliding_window_view
    for s in range(0, n, 8192):
        e = min(n, s + 8192)
        v, at = wide(px[s : e + 2 * half], 2 * half + 1), wide(pt[s : e + 2 * half], 2 * half + 1)
        v = np.sort(np.where(np.abs(at - t[s:e, None]) <= reach, v, np.nan), axis=1)  # NaN come last
        known = np.isfinite(v).sum(axis=1)
        row = np.arange(e - s)
        mid = 0.5 * (v[row, np.maximum(known - 1, 0) // 2] + v[row, np.minimum(known // 2, 2 * half)])
        out[s:e] = np.where(known > 0, mid, np.nan)
    return out


def forward_backward(log_e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior of each state at each step; rows of ``log_e`` are steps.

    Steps are laid out in about sqrt(n) blocks. Every block's product of step matrices is built for all
    blocks at once, the blocks are chained, and then all blocks are stepped through from their own start.
    """
    n, k = log_e.shape
    e = np.exp(log_e - log_e.max(axis=1, keepdims=True))
    size = max(int(np.sqrt(n)), 1)
    blocks = -(-n // size)
    e = np.concatenate([e, np.ones((blocks * size - n, k))]).reshape(blocks, size, k)
    unit = lambda a: a / a.sum(axis=-1, keepdims=True)

    def scale(m: np.ndarray) -> np.ndarray:
        return m / m.max(axis=(1, 2), keepdims=True)

    # forward: a row vector times trans times the step's emissions; the first step starts from ``start``
    e[0, 0] *= start / (np.full(k, 1.0 / k) @ trans)
    whole = np.tile(np.eye(k), (blocks, 1, 1))
    for i in range(size):
        whole = scale((whole @ trans) * e[:, None, i])
    first = np.empty((blocks, k))
    cur = np.full(k, 1.0 / k)
    for b in range(blocks):
        first[b] = cur
        cur = cur @ whole[b]
        cur = cur / np.abs(cur).sum()
    f = np.empty((blocks, size, k))
    cur = first
    for i in range(size):
        cur = unit((cur @ trans) * e[:, i])
        f[:, i] = cur
    # backward: trans times (emissions times what follows)
    whole = np.tile(np.eye(k), (blocks, 1, 1))
    for i in range(size - 1, -1, -1):
        whole = scale((trans * e[:, i, None]) @ whole)
    last = np.empty((blocks, k))
    cur = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        last[b] = cur
        cur = whole[b] @ cur
        cur = cur / cur.sum()
    back = np.empty((blocks, size, k))
    cur = last
    for i in range(size - 1, -1, -1):
        back[:, i] = cur
        cur = unit((cur * e[:, i]) @ trans.T)
    return unit((f * back).reshape(-1, k)[:n])


def one_value(value: np.ndarray, m: Model) -> np.ndarray:
    """True where a reading goes on a run of one value; short runs far aside and unknown counts do not end it."""
    size = len(value)
    on = np.zeros(size, bool)
    at = np.flatnonzero(np.isfinite(value))
    if len(at) == 0:
        return on
    v = value[at]
    logs = np.log1p(np.maximum(v, 0))
    aside = np.zeros(len(v), bool)
    held = np.concatenate([[False], v[1:] == v[:-1]])  # the value has stood for two readings at least
    for k in range(1, min(m.aside_readings, len(v) - 2) + 1):
        back = held[: -k - 1] & (v[: -k - 1] == v[k + 1 :])
        for j in range(1, k + 1):
            back &= np.abs(logs[j : len(v) - k - 1 + j] - logs[: -k - 1]) >= m.aside
        for j in range(1, k + 1):
            aside[j : len(v) - k - 1 + j] |= back
    at = at[~aside]
    inside = np.zeros(size, bool)
    inside[at] = True
    v = value[at]
    on[at] = np.concatenate([[False], v[1:] == v[:-1]])
    # what was left aside goes on with the run about it
    last = np.maximum.accumulate(np.where(inside, np.arange(size), -1))
    nxt = np.minimum.accumulate(np.where(inside, np.arange(size), size)[::-1])[::-1]
    within = ~inside & (last >= 0) & (nxt < size)
    on[within] = on[nxt[within]]
    return on


@dataclass
class Series:
    """One span's readings, its surroundings included, in order of time."""

    t: np.ndarray
    value: np.ndarray
    code: np.ndarray
    own: np.ndarray
    bad: np.ndarray
    again: np.ndarray  # goes on a stretch of contents served before
    steady: np.ndarray  # goes on a stretch of one value
    m: Model

    @classmethod
    def of(cls, pdf: pd.DataFrame, m: Model) -> Series:
        t, bad = pdf["_t"].to_numpy(np.float64), pdf["_bad"].to_numpy(bool)
        value = np.where(bad, np.nan, pdf["_n"].to_numpy(np.float64))
        code, _ = pd.factorize(pdf["_hash"])
        soon = np.concatenate([[False], np.diff(t) <= REACH_DAYS * DAY])
        silent = code < 0  # told no contents: neither opens nor ends a stretch
        return cls(t, value, code, pdf["_own"].to_numpy(bool), bad, (pdf["_seen"].to_numpy(bool) | silent) & soon, one_value(value, m) & soon, m)

    @property
    def y(self) -> np.ndarray:
        return np.where(self.value > 0, np.log1p(np.clip(self.value, 0, None)), np.nan)

    @property
    def slot(self) -> np.ndarray:
        return ((self.t // 3600) % 24 * 7 + (self.t // DAY) % 7).astype(int)

    @property
    def anchor(self) -> np.ndarray:
        """Of each reading the first one that told the same count, contents unchanged since."""
        at = np.arange(len(self.t))
        kept = np.concatenate([[False], (self.code[1:] == self.code[:-1]) & (self.code[1:] >= 0)])
        pair = np.cumsum(~kept) * (1 << 33) + np.nan_to_num(self.value, nan=-1.0).astype(np.int64)
        _, first, which = np.unique(pair, return_index=True, return_inverse=True)
        return np.where(np.isfinite(self.value), first[which.ravel()], at)

    def level(self, x: np.ndarray, half: int) -> np.ndarray:
        return running_median(x, self.t, half, REACH_DAYS * DAY)


    def day_level(self) -> np.ndarray:
        """The level over a day about each reading, on medians per hour, however densely the source is read."""
        hour = (self.t // 3600).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], hour[1:] != hour[:-1]]))
        size = np.diff(np.append(begins, len(hour)))
        y = self.y
        ordered = y[np.lexsort((y, hour))]  # unknown counts come last in their hour
        known = np.add.reduceat(np.isfinite(y).astype(int), begins)
        mid = 0.5 * (ordered[begins + np.maximum(known - 1, 0) // 2] + ordered[begins + np.minimum(known // 2, size - 1)])
        level = running_median(np.where(known > 0, mid, np.nan), self.t[begins], self.m.half_window, REACH_DAYS * DAY)
        return np.repeat(level, size)


def report(key: str, span: int, s: Series) -> pd.DataFrame:
    """A span's part of its source's statistics (``REPORT``): residuals, stretches that lie within, edges."""
    kinds: list[str] = []
    cells: list[np.ndarray] = []  # slot, bin, n
    y = s.y
    r = np.round((y - s.day_level()) * 100)
    use = s.own & np.isfinite(r) & (s.anchor == np.arange(len(y)))
    both, n = np.unique(s.slot[use] * (1 << 20) + r[use].astype(int) + (1 << 19), return_counts=True)
    kinds += ["r"] * len(both)
    cells.append(np.stack([both >> 20, (both & ((1 << 20) - 1)) - (1 << 19), n]))
    own = np.flatnonzero(s.own)
    edge = None
    if len(own):
        t = s.t[own]
        edge = [float(t[0]), float(t[-1])]
        for kind, on in (("c", s.again[own]), ("v", s.steady[own])):
            begins = np.flatnonzero(~on)
            ends = np.append(begins[1:], len(t)) - 1
            # the stretches before the first opener and after the last belong to the edges
            bins, n = np.unique(((t[ends[:-1]] - t[begins[:-1]]) / 900.0).astype(int), return_counts=True)
            kinds += [kind] * len(bins)
            cells.append(np.stack([np.zeros(len(bins), int), bins, n]))
            if len(begins):
                edge += [float(t[begins[0] - 1]) if begins[0] else np.nan, float(t[begins[-1]])]
            else:
                edge += [float(t[-1]), np.nan]
        kinds.append("e")
        cells.append(np.array([[span], [0], [1]]))
    told = np.concatenate(cells, axis=1).astype(np.int64)
    v = np.full(len(kinds), None, object)
    if edge is not None:
        v[-1] = edge
    return pd.DataFrame({"_key": np.full(len(kinds), key, object), "kind": np.array(kinds, object), "slot": told[0], "bin": told[1], "n": told[2], "v": v})


def _quantile(bins: np.ndarray, n: np.ndarray, q: float) -> float:
    """The q-quantile (lower) of counted bins."""
    if n.sum() == 0:
        return np.nan
    order = np.argsort(bins, kind="stable")
    c = np.cumsum(n[order])
    return float(bins[order][np.searchsorted(c, q * c[-1], side="left")])


def _grouped_medians(group: np.ndarray, r: np.ndarray, n: np.ndarray, groups: int, least: int) -> np.ndarray:
    out = np.zeros(groups)
    order = np.lexsort((r, group))
    group, r, n = group[order], r[order], n[order]
    ends = np.searchsorted(group, np.arange(groups + 1))
    c = np.concatenate([[0], np.cumsum(n)])
    for g in range(groups):
        a, b = ends[g], ends[g + 1]
        if c[b] - c[a] >= least:
            out[g] = r[np.searchsorted(c[a + 1 : b + 1], c[a] + 0.5 * (c[b] - c[a]), side="left") + a]
    return out - np.median(out)


def fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """A source's parameters, and what each of its spans must know of the others (``FITTED``)."""
    key = pdf["_key"].iloc[0]
    kinds, slots, bins_of, counts, told = (pdf[c].to_numpy() for c in ("kind", "slot", "bin", "n", "v"))
    part = {k: np.flatnonzero(kinds == k) for k in "rcve"}
    slot, r, n = slots[part["r"]].astype(int), bins_of[part["r"]] / 100.0, counts[part["r"]].astype(float)
    hour, dow = np.zeros(24), np.zeros(7)
    for _ in range(3):
        hour = _grouped_medians(slot // 7, r - dow[slot % 7], n, 24, 5)
        dow = _grouped_medians(slot % 7, r - hour[slot // 7], n, 7, 12)
    rhythm = (hour[:, None] + dow[None, :]).ravel()
    rest = r - rhythm[slot]
    spread = 1.4826 * _quantile(np.abs(rest - _quantile(rest, n, 0.5)), n, 0.5) if n.sum() >= 8 else 0.25
    spans = part["e"][np.argsort(slots[part["e"]], kind="stable")]
    v = np.array([list(x) for x in told[spans]], float).reshape(-1, 6)
    usual, edges = [], np.full((len(v), 4), np.nan)
    for j, kind in enumerate("cv"):
        head, tail = v[:, 2 + 2 * j], v[:, 3 + 2 * j]
        # what comes in from the spans before: the opener of a stretch still open there
        began = np.nan
        hours = []
        for i in range(len(v)):
            if np.isnan(head[i]):
                began = np.nan  # the span opens with a stretch of its own
            edges[i, 2 * j] = began if not np.isnan(head[i]) else np.nan
            began = tail[i] if not np.isnan(tail[i]) else began
        # where the stretch ends that is open at a span's end
        for i in range(len(v) - 1, -1, -1):
            end, k = v[i, 1], i + 1
            if k < len(v) and not np.isnan(head[k]):
                end = edges[k, 2 * j + 1] if np.isnan(tail[k]) else head[k]
            edges[i, 2 * j + 1] = end
            if not np.isnan(tail[i]):
                hours.append((end - tail[i]) / 3600.0)
        bins = np.concatenate([bins_of[part[kind]] / 4.0, np.floor(np.array(hours) * 4) / 4])
        q = _quantile(bins, np.concatenate([counts[part[kind]], np.ones(len(hours))]), 0.9)
        usual.append(0.0 if np.isnan(q) else q)
    return pd.DataFrame(
        {"_key": key, "_span": slots[spans].astype(np.int64), "rhythm": [rhythm.tolist()] * len(v), "spread": spread, "usual": [usual] * len(v), "edges": edges.tolist()}
    ).astype({"_key": object})


def transitions(m: Model) -> np.ndarray:
    es, ek, er, lk = m.enter_spike, m.enter_stuck, m.enter_range, m.leave_stuck
    out = np.array(
        [
            [0.0, es, ek, ek, er],
            [0.0, m.stay_spike, ek, ek, er],
            [0.0, es, 1 - lk - es - er - ek, ek, er],
            [0.0, es, ek, 1 - lk - es - er - ek, er],
            [0.0, es, ek, ek, er],
        ]
    )
    out[:, 0] = 1 - out.sum(axis=1)
    return out


def _lasting(t: np.ndarray, on: np.ndarray, own: np.ndarray, began: float, ends: float) -> np.ndarray:
    """Hours of the stretch each reading goes on; 0 for readings that open one.

    ``began``, ``ends``: of the stretches that reach over the span's own first and last reading.
    """
    mine = np.flatnonzero(own)
    if len(mine) == 0:
        return np.zeros(len(t))
    which = np.cumsum(~on)  # 0: a stretch that began before everything seen here
    begins = np.flatnonzero(~on)
    start = np.concatenate([[t[0]], t[begins]])[which]
    last = np.zeros(which[-1] + 1)
    np.maximum.at(last, which, t)
    end = last[which]
    if on[mine[0]] and np.isfinite(began):
        start = np.where(which == which[mine[0]], began, start)
    end = np.where(which == which[mine[-1]], np.maximum(ends, end), end)
    return np.where(on, (end - start) / 3600.0, 0.0)


def _stuck(lasting: np.ndarray, on: np.ndarray, usual: float, ratio: float, m: Model) -> np.ndarray:
    """How far a stretch's length speaks for a stuck source, as a log ratio."""
    long = on & (lasting > m.stuck_hours)
    turn = max(m.stuck_hours, ratio * (usual + 0.5))
    with np.errstate(divide="ignore"):
        told = m.tail * np.log(np.maximum(lasting, 1e-9) / turn)
    return np.where(long, np.clip(told, -40.0, 40.0), -60.0)


def posteriors(s: Series, rhythm: np.ndarray, spread: float, usual: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Probability of each state of :data:`STATES` for each reading."""
    m, y, size = s.m, s.y, len(s.t)
    beat = rhythm[s.slot]
    level = s.level(y - beat, m.half_window)
    # at a lasting change of level one side of a reading fits and the other does not: take the nearer
    side = max(m.half_window // 2, 1)
    near = s.level(y - beat, side)
    at = np.arange(size)
    sides = np.stack([level, near[np.maximum(at - side, 0)], near[np.minimum(at + side, size - 1)]])
    gap = np.where(np.isfinite(sides), np.abs(y - beat - sides), np.inf)
    fallback = np.nanmedian(y) if np.isfinite(y).any() else 0.0
    expected = sides[np.where(np.isfinite(y), gap.argmin(axis=0), 0), at] + beat
    expected = np.where(np.isfinite(expected), expected, fallback)
    off = np.where(np.isfinite(y), y - expected, 0.0)
    # contents served again carry the count of the poll that first served them: compare it to its time
    anchor = s.anchor
    recent = (anchor < at) & (s.t - s.t[anchor] <= REACH_DAYS * DAY)
    lagged = y - expected[anchor]
    off = np.where(recent & (np.abs(lagged) < np.abs(off)), lagged, off)
    scale = np.maximum(spread, np.maximum(m.least_spread, m.least_count / np.maximum(np.exp(expected), 1.0)))
    z = off / scale
    known = np.isfinite(s.value)
    none = known & (s.value == 0) & (np.expm1(expected) > 0.5)
    close = np.abs(z) < m.least_z
    count = np.where(known, -0.5 * z**2 - np.log(scale) - 0.919, 0.0)
    even = np.where(known, -np.log(m.spike_range), 0.0)
    count = np.where(none, -60.0, count)
    either = np.maximum(count, even)
    spike = np.where(~known | (close & ~none), -60.0, even)
    contents = _stuck(_lasting(s.t, s.again, s.own, edges[0], edges[1]), s.again, usual[0], m.contents_ratio, m)
    value = _stuck(_lasting(s.t, s.steady, s.own, edges[2], edges[3]), s.steady, usual[1], m.value_ratio, m)
    inside = np.where(s.bad, -60.0, 0.0)
    # contents that stay put keep their count as well
    e = np.column_stack([count + inside, spike + inside, either + contents + np.maximum(value, 0.0) + inside, either + value + inside, np.where(s.bad, 0.0, -60.0)])
    return forward_backward(e, transitions(m), np.array([0.95, 0.01, 0.02, 0.01, 0.01]))


def states(post: np.ndarray) -> np.ndarray:
    """The state each reading is given: normal unless the others together are likelier, then their likeliest."""
    other = post[:, 1:].argmax(axis=1) + 1
    return np.where(post[:, 0] >= 0.5, 0, other)


def _report_span(m: Model):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "_id"], kind="stable")
        return report(pdf["_key"].iloc[0], int(pdf["_span"].iloc[0]), Series.of(pdf, m))

    return run


def _run_span(m: Model):
    def run(pdf: pd.DataFrame, params: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(params):
            return pd.DataFrame({"_id": np.empty(0, np.int64), "_p_spike": np.empty(0), "_p_stuck": np.empty(0), "_state": np.empty(0, object)})
        pdf = pdf.sort_values(["_t", "_id"], kind="stable")
        s, p = Series.of(pdf, m), params.iloc[0]
        post = posteriors(s, np.array(p["rhythm"]), float(p["spread"]), np.array(p["usual"]), np.array(p["edges"], float))
        out = pd.DataFrame({"_id": pdf["_id"].to_numpy(), "_p_spike": post[:, 1], "_p_stuck": post[:, 2] + post[:, 3], "_state": np.array(STATES, object)[states(post)]})
        return out[s.own]

    return run


def collection_end(times: DataFrame, at: Column, bounds: Bounds) -> DataFrame:
    """One row ``_late``: seconds after which no reading can lie; found on the days with readings alone."""
    days = times.filter(at >= F.to_timestamp(F.lit(bounds.starts))).select(F.floor(at.cast("double") / DAY).alias("d")).distinct()
    # a few thousand days: gathered as one sorted array
    all_days = days.agg(F.array_sort(F.collect_list("d")).alias("a"))
    last = F.aggregate("a", F.element_at(F.concat("a", F.array(F.lit(0).cast("long"))), 1), lambda acc, d: F.when(d - acc <= bounds.late_days, d).otherwise(acc))
    return all_days.select(((last + 1) * DAY).alias("_late"))


def flag_readings(
    polls: DataFrame,
    reading: str,
    source: str,
    at: str,
    count: str,
    fresh_count: str,
    contents: str,
    answered: Column,
    bounds: Bounds = Bounds(),
    model: Model = Model(),
) -> DataFrame:
    """One row per reading id: ``_id, _source, _state, _p_spike, _p_stuck, _flagged``.

    States: see :data:`STATES`. Readings that were not answered are normal, whatever they hold; answered
    ones beyond the bounds in time are out of range and take no part in the model. Repeated ids
    count once (the least row); a null id is left out, a null source is a source of its own, a null
    time cannot be placed and is normal, a null count is never a spike. Empty input gives no rows.
    """
    cols = {"_source": F.col(source), "_at": F.col(at), "_n": F.col(count).cast("double"), "_new": F.col(fresh_count).cast("double"), "_hash": F.col(contents), "_ok": F.coalesce(answered, F.lit(False))}
    base = polls.filter(F.col(reading).isNotNull()).groupBy(F.col(reading).cast("long").alias("_id")).agg(F.min(F.struct(*[c.alias(k) for k, c in cols.items()])).alias("r"))
    base = base.select("_id", "r.*")
    late = collection_end(polls, F.col(at), bounds)
    base = base.crossJoin(F.broadcast(late)).withColumn("_t", F.col("_at").cast("double"))  # one row
    when_bad = (F.col("_at") < F.to_timestamp(F.lit(bounds.starts))) | (F.col("_t") >= F.col("_late"))
    count_bad = (F.col("_n") < 0) | (F.col("_n") > bounds.max_items)
    new_bad = (F.col("_new") < 0) | ((F.col("_new") > F.col("_n")) & (F.col("_n") >= 0))
    base = base.select(
        "_id", "_source", "_t", "_n", "_hash", "_ok",
        F.coalesce(F.concat(F.lit("="), F.col("_source").cast("string")), F.lit("")).alias("_key"),
        F.coalesce(when_bad, F.lit(False)).alias("_when_bad"),
        F.coalesce(count_bad, F.lit(False)).alias("_bad"),
        F.coalesce(new_bad, F.lit(False)).alias("_new_bad"),
    )
    base = cut(base, "readings")
    used = base.filter("_ok and not _when_bad and _t is not null")
    first = used.filter("_hash is not null").groupBy("_key", "_hash").agg(F.min(F.struct("_t", "_id")).alias("f")).select("_key", "_hash", F.col("f._id").alias("_first"))
    marked = used.join(first, ["_key", "_hash"], "left")
    halo, length = HALO_DAYS * DAY, SPAN_DAYS * DAY
    span = lambda t: F.floor(t / length)
    marked = marked.withColumn("_span", F.explode(F.sequence(span(F.col("_t") - halo), span(F.col("_t") + halo))))
    marked = marked.select(
        "_key", "_span", "_id", "_t", "_n", F.when(F.col("_hash").isNotNull(), F.xxhash64("_hash")).alias("_hash"),
        "_bad", (F.col("_span") == span(F.col("_t"))).alias("_own"), F.coalesce(F.col("_first") != F.col("_id"), F.lit(False)).alias("_seen"),
    )
    marked = cut(marked, "spans")
    told = marked.groupBy("_key", "_span").applyInPandas(_report_span(model), REPORT)
    told = told.groupBy("_key", "kind", "slot", "bin").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    params = told.groupBy("_key").applyInPandas(fit, FITTED)
    found = marked.groupBy("_key", "_span").cogroup(params.groupBy("_key", "_span")).applyInPandas(_run_span(model), SCHEMA)
    out = base.join(found, "_id", "left")
    hard = F.col("_ok") & (F.col("_when_bad") | F.col("_bad") | F.col("_new_bad"))
    state = F.when(hard, F.lit(STATES[4])).otherwise(F.coalesce("_state", F.lit(STATES[0])))
    return out.select(
        "_id", "_source", state.alias("_state"), F.coalesce("_p_spike", F.lit(0.0)).alias("_p_spike"), F.coalesce("_p_stuck", F.lit(0.0)).alias("_p_stuck"),
        (state != STATES[0]).alias("_flagged"),
    )

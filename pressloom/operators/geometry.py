"""Area-proportional layout of a few dozen shapes in a disc, by a power diagram (numpy, driver side).

A row of the disc belongs, at each point, to the shape with the least squared distance minus weight.
Along a row the common x squared cancels, so shapes are straight lines and the row's owners are the
lower envelope; shares of a row come out exactly. Rows are independent and handled as arrays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# fixed values
ROWS, RELAX, ROUNDS, BAND, SPRING = 420, 520, 160, 0.14, 0.92
STUCK_ROUNDS, STUCK_PUSH, WEIGHT_LIMIT = 3, 8.0, 1.6


@dataclass
class Layout:
    ids: list
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    target: np.ndarray = field(default_factory=lambda: np.empty(0))


def spans(x: np.ndarray, y: np.ndarray, w: np.ndarray, row: float) -> list[tuple[int, float, float]]:
    """(shape, from, to) left to right on one row; rows outside the disc have none."""
    if abs(row) >= 1:
        return []
    edge = float(np.sqrt(1 - row * row))
    slope, height = -2.0 * x, x * x + (row - y) ** 2 - w
    at, here, out = -edge, int(np.lexsort((np.arange(len(x)), slope, np.round(slope * -edge + height, 12)))[0]), []
    while True:
        # the next owner is the line that overtakes the present one soonest
        steeper = slope < slope[here] - 1e-15
        with np.errstate(all="ignore"):
            cross = np.where(steeper, (height - height[here]) / (slope[here] - slope), np.inf)
        cross = np.where(cross < at, at, cross)
        nxt = float(cross.min(initial=np.inf))
        if not np.isfinite(nxt) or nxt >= edge:
            out.append((here, at, edge))
            return [s for s in out if s[2] > s[1]]
        out.append((here, at, nxt))
        ties = np.flatnonzero(cross <= nxt + 1e-15)
        here, at = int(ties[np.argmin(slope[ties])]), nxt


def areas(x: np.ndarray, y: np.ndarray, w: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Each shape's share of the disc; all rows and shapes at once.

    On a row shape i owns [max over steeper j, min over flatter j] of the crossings with j.
    """
    n = len(x)
    ys = -1 + (np.arange(rows) + 0.5) * 2 / rows
    edge = np.sqrt(1 - ys * ys)
    height = x[None, :] ** 2 + (ys[:, None] - y[None, :]) ** 2 - w[None, :]
    lo, hi = np.repeat(-edge[:, None], n, 1), np.repeat(edge[:, None], n, 1)
    for j in range(n):
        d = 2.0 * (x - x[j])  # slope of j minus slope of i
        diff = height - height[:, [j]]
        with np.errstate(all="ignore"):
            cross = diff / d[None, :]
        hi = np.where(d[None, :] < 0, np.minimum(hi, cross), hi)
        lo = np.where(d[None, :] > 0, np.maximum(lo, cross), lo)
        level = np.abs(d) <= 1e-15
        beaten = level[None, :] & ((diff > 0) | ((diff == 0) & (np.arange(n)[None, :] > j)))
        hi = np.where(beaten, -2.0, hi)
    share = np.clip(hi - lo, 0, None).sum(axis=0)
    total = share.sum()
    return share / total if total > 0 else share


def _rings(rank_keys: np.ndarray) -> np.ndarray:
    n = len(rank_keys)
    place = np.empty(n)
    place[np.argsort(rank_keys, kind="stable")] = np.arange(n)
    return 0.09 + 0.83 * (place / (n - 1) if n > 1 else np.zeros(n))


def _space_out(x: np.ndarray, y: np.ndarray, ring: np.ndarray, angle: np.ndarray, radius: np.ndarray, passes: int) -> None:
    """Pushes overlapping seeds apart, all pairs at once, and lets them slide along their rings."""
    want = (radius[:, None] + radius[None, :]) * 1.05
    np.fill_diagonal(want, 0.0)
    for _ in range(passes):
        dx, dy = x[:, None] - x[None, :], y[:, None] - y[None, :]
        apart = np.maximum(np.hypot(dx, dy), 1e-6)
        push = np.clip(want - apart, 0.0, None) * 0.225 / apart
        x += (dx * push).sum(axis=1)
        y += (dy * push).sum(axis=1)
        turn = np.angle(np.exp(1j * (np.arctan2(y, x) - angle)))
        theta, r = angle + turn * SPRING, np.clip(np.hypot(x, y), ring - BAND, ring + BAND)
        x[:], y[:] = r * np.cos(theta), r * np.sin(theta)


def _fit_weights(x: np.ndarray, y: np.ndarray, w: np.ndarray, target: np.ndarray, rounds: int, rows: int, rate: float) -> np.ndarray:
    stuck = np.zeros(len(x), int)
    for t in range(rounds):
        got = areas(x, y, w, rows)
        step = rate * 0.968**t + 0.14
        stuck = np.where(got <= 0, stuck + 1, 0)
        move = step * (target - got) * 2.4 + np.where(stuck >= STUCK_ROUNDS, step * target * STUCK_PUSH, 0.0)
        w = np.clip(w + move, -WEIGHT_LIMIT, WEIGHT_LIMIT)
        w = w - w.mean()
    return w


def fit(ids: list, angle: np.ndarray, rank_keys: np.ndarray, area: np.ndarray, rows: int = ROWS, relax: int = RELAX, rounds: int = ROUNDS, before: Layout | None = None) -> Layout:
    """A layout whose shapes have the given shares; from ``before`` shapes that stay start where they were."""
    n = len(ids)
    if not n:
        return Layout([], np.empty(0), np.empty(0), np.empty(0))
    angle, area = np.asarray(angle, float), np.asarray(area, float)
    target = area / (area.sum() or 1.0)
    ring = _rings(np.asarray(rank_keys))
    x, y, w, rate = ring * np.cos(angle), ring * np.sin(angle), np.zeros(n), 0.85
    if before is not None:
        known = {i: k for k, i in enumerate(before.ids)}
        rate, low = 0.30, float(before.w.min(initial=0.0)) - 0.05
        for i, name in enumerate(ids):
            k = known.get(name)
            x[i], y[i], w[i] = (before.x[k], before.y[k], before.w[k]) if k is not None else (x[i], y[i], low)
    _space_out(x, y, ring, angle, np.sqrt(target), relax)
    return Layout(list(ids), x, y, _fit_weights(x, y, w, target, rounds, rows, rate), target)


def check(layout: Layout, rows: int = ROWS) -> dict:
    """Worst and mean relative error of area, and shapes without any."""
    got = areas(layout.x, layout.y, layout.w, rows)
    err = np.abs(got - layout.target) / np.where(layout.target > 0, layout.target, 1.0)
    return {"worst": float(err.max(initial=0)), "mean": float(err.mean()) if len(err) else 0.0, "empty": [i for i, g in zip(layout.ids, got, strict=True) if g <= 1e-9], "areas": got}


def radial_order(layout: Layout, rank_keys: np.ndarray) -> float | None:
    """Rank correlation (ties in order) of breadth and distance from the centre; None under three shapes."""
    if len(layout.ids) < 3:
        return None
    a, b = np.empty(len(layout.ids)), np.empty(len(layout.ids))
    a[np.argsort(np.asarray(rank_keys), kind="stable")] = np.arange(len(a))
    b[np.argsort(np.hypot(layout.x, layout.y), kind="stable")] = np.arange(len(b))
    return float(np.corrcoef(a, b)[0, 1])


def outlines(layout: Layout, rows: int = 160) -> dict:
    """Per shape a closed polygon from its row spans."""
    left: dict = {i: [] for i in layout.ids}
    right: dict = {i: [] for i in layout.ids}
    for k in range(rows):
        row = -1 + (k + 0.5) * 2 / rows
        for cell, a, b in spans(layout.x, layout.y, layout.w, row):
            left[layout.ids[cell]].append((a, row))
            right[layout.ids[cell]].append((b, row))
    return {i: left[i] + right[i][::-1] for i in layout.ids if left[i]}


def label_anchors(layout: Layout, grid: int = 150) -> dict:
    """Per shape the grid point deepest inside it and that depth (distance to the nearest other owner)."""
    c = -1 + (np.arange(grid) + 0.5) * 2 / grid
    gx, gy = np.meshgrid(c, c)
    score = (gx[..., None] - layout.x) ** 2 + (gy[..., None] - layout.y) ** 2 - layout.w
    owner = np.where(gx**2 + gy**2 < 1, score.argmin(axis=-1), -1)
    depth = np.full(owner.shape, 0.0)
    inside = owner >= 0
    ring = 0
    alive = inside.copy()
    while alive.any():  # peel shapes by one grid step a round
        ring += 1
        depth[alive] = ring
        keep = alive.copy()
        for ax, step in ((0, 1), (0, -1), (1, 1), (1, -1)):
            moved, near = np.roll(alive, step, ax), np.roll(owner, step, ax)
            keep &= moved & (near == owner)
        alive = keep
    out = {}
    for k, i in enumerate(layout.ids):
        mine = np.where(owner == k, depth, 0)
        if mine.max(initial=0) > 0:
            a, b = np.unravel_index(int(mine.argmax()), mine.shape)
            out[i] = (float(gx[a, b]), float(gy[a, b]), float(mine[a, b] * 2 / grid))
    return out

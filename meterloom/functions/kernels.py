"""Arrow-batched numeric kernels: one array (or pair of arrays) per row.

Spark partitions and shuffles the rows; a kernel only does the arithmetic
that column expressions cannot express, on the arrays of one batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR_BYTES = 1 << 19  # of a diagonal: pairs are processed in slices whose diagonals stay in cache
WHOLE = 2.0**24  # whole numbers below are exact in single precision; larger sums never round to below
WHOLE_VALUE = 2**11  # whole numbers whose differences have exact squares in it
CHECKED = 4  # diagonals between two looks for pairs to give up, at least
LOOKS = 16  # looks at most


def dtw_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray | None = None, nb: np.ndarray | None = None) -> np.ndarray:
    """DTW of row i of ``a`` with row i of ``b``: root of the least sum of squared differences.

    Sweeps anti-diagonals, each computed for all pairs at once. Rows may be
    padded behind their true lengths ``na`` and ``nb``.
    """
    x, y = _halved(a, b)
    out = squared_dtw_pairs(x, y, na, nb)
    if x.itemsize < a.itemsize and len(long := np.flatnonzero(out >= WHOLE)):
        out[long] = squared_dtw_pairs(a[long], b[long], *(n if n is None else n[long] for n in (na, nb)))
    return np.sqrt(out)


def _halved(a: np.ndarray, b: np.ndarray):
    """Both in single precision if that is exact: whole numbers, whose squared DTW is exact in it below ``WHOLE``."""
    if all(_whole(v) for v in (a[:1], b[:1], a, b)):
        return a.astype(np.float32), b.astype(np.float32)
    return a, b


def _whole(v: np.ndarray) -> bool:
    return np.array_equal(v, np.rint(v)) and np.abs(v).max(initial=0) <= WHOLE_VALUE


def rounded(values, radius: float):
    """Arrays in single precision, a radius below which lie all that are below ``radius`` exactly, and whether it is exact; None if it says little."""
    flat = np.concatenate(values)
    if radius * radius < WHOLE and _whole(flat):
        return [np.asarray(v, dtype=np.float32) for v in values], radius, True
    least, most, n = np.fmin.reduce(flat), np.fmax.reduce(flat), max(map(len, values))
    middle = (least + most) / 2
    limit = radius * radius
    error = _single_error(2 * n, most - middle)(limit)
    if not error <= 0.1 * limit:
        return None
    return [(np.asarray(v, dtype=float) - middle).astype(np.float32) for v in values], np.sqrt(limit + error) * (1 + 1e-9), False


def _diagonals(a: np.ndarray, b: np.ndarray, kept: np.ndarray | None = None):
    """Accumulated costs of each anti-diagonal ``s``, a column per pair: row i + 1 holds cell (i, s - i).

    Three buffers are written in turn, or row ``s`` of ``kept``. Rows next to a
    diagonal's cells are infinite; rows further out are never read. What is sent
    back, a mask of pairs, keeps only those from then on.
    """
    n, la = a.shape
    lb = b.shape[1]
    x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(b[:, ::-1].T)
    older, old, new = (np.full((la + 2, n), np.inf, x.dtype) for _ in range(3))
    cost = np.empty((min(la, lb), n), x.dtype)
    for s in range(la + lb - 1):
        lo, hi = max(0, s - lb + 1), min(la - 1, s)
        if kept is not None:
            new = kept[s]
        inner, added = new[lo + 1 : hi + 2], cost[: hi - lo + 1]
        np.subtract(x[lo : hi + 1], y[lb - 1 - s + lo : lb - s + hi], out=added)
        np.multiply(added, added, out=added)
        if s == 0:
            inner[:] = added
        else:
            np.minimum(old[lo + 1 : hi + 2], old[lo : hi + 1], out=inner)
            np.minimum(inner, older[lo : hi + 1], out=inner)
            inner += added
        new[lo] = new[hi + 2] = np.inf
        keep = yield s, old, new
        if keep is not None:
            x, y, old, new = (np.ascontiguousarray(v[:, keep]) for v in (x, y, old, new))
            older, cost = np.empty_like(old), np.empty((len(cost), x.shape[1]), x.dtype)
        older, old, new = old, new, older


def dtw_pairs_below(a: np.ndarray, b: np.ndarray, radius: float, na: np.ndarray | None = None, nb: np.ndarray | None = None) -> np.ndarray:
    """As ``dtw_pairs``, but NaN at or beyond ``radius``, giving up on a pair as soon as that is certain.

    Every path crosses one of any two consecutive diagonals and its cost only
    grows, so a pair whose two last diagonals exceed the radius is beyond it.
    """
    if a.itemsize > 4 and radius * radius < WHOLE:
        a, b = _halved(a, b)
    row, last = _ends(a, b, na, nb)
    out = np.full(len(a), np.nan)
    step = max(1, PAIR_BYTES // max(a.shape[1] * a.itemsize, 1))
    for s in range(0, len(a), step):
        at = slice(s, s + step)
        _dtw_slice_below(a[at], b[at], row[at], last[at], np.float64(radius * radius), out[at])
    out = np.sqrt(out)
    out[~(out < radius)] = np.nan
    return out


def _dtw_slice_below(a, b, row, last, limit, out) -> None:
    la, lb = a.shape[1], b.shape[1]
    rows, sweep, every = np.arange(len(a)), _diagonals(a, b), max(CHECKED, (la + lb) // LOOKS)
    ends = set(last.tolist())
    s, old, new = next(sweep)
    while True:
        if s in ends:
            here = np.flatnonzero(last[rows] == s)
            out[rows[here]] = new[row[rows[here]], here]
            if s == last.max():
                return
        keep = None
        if s % every == 0:
            near = slice(max(0, s - lb + 1), min(la - 1, s) + 3)  # with the cells of the diagonal before
            alive = (np.minimum(new[near].min(axis=0), old[near].min(axis=0) if s else np.inf) < limit) & (last[rows] > s)
            if alive.mean() < 0.75:
                rows, keep = rows[alive], alive
                if not len(rows):
                    return
        s, old, new = sweep.send(keep)


WARP_ROWS = 64  # pairs measured at once
WARP_PAIRS = 256  # pairs traced back at once
WARP_STORED = 1 << 28  # bytes of all diagonals kept for the way back, about half of them used
WARP_USED = 1 << 20  # cells followed at once, from as many pairs as hold them
SOFT_FAR = 40.0  # e^-40 of a sum is below its rounding


def padded(arrays) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of mixed lengths as one matrix with zeros behind, and the lengths."""
    sizes = np.array([len(v) for v in arrays], dtype=int)
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    for row, v in zip(out, arrays):
        row[: len(v)] = v
    return out, sizes


def single(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray):
    """Padded rows in single precision around their middle, and the error of a squared DTW of them by its value.

    Rounding the values puts a cell's cost off by at most 10 epsilons of the
    largest square, rounding the sum adds an epsilon of it per step.
    """
    known = [np.arange(v.shape[1]) < n[:, None] for v, n in ((a, na), (b, nb))]
    ends = [f(v, where=k, initial=z) for v, k in zip((a, b), known) for f, z in ((np.min, np.inf), (np.max, -np.inf))]
    middle = (min(ends[::2]) + max(ends[1::2])) / 2
    rows = [np.where(k, v - middle, 0).astype(np.float32) for v, k in zip((a, b), known)]
    return *rows, _single_error(a.shape[1] + b.shape[1], max(ends[1::2]) - middle)


def _single_error(steps: int, largest: float):
    step = steps * np.finfo(np.float32).eps
    return lambda value: step * (12 * largest**2 + 1.1 * value)


def squared_dtw_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray | None = None, nb: np.ndarray | None = None) -> np.ndarray:
    """Squared DTW of paired rows, which may be padded as in ``soft_dtw_pairs``."""
    row, last = _ends(a, b, na, nb)
    out = np.empty(len(a))
    step = max(1, PAIR_BYTES // max(a.shape[1] * a.itemsize, 1))
    for s in range(0, len(a), step):
        at = slice(s, s + step)
        ending = {d: np.flatnonzero(last[at] == d) for d in np.unique(last[at])}
        for d, _, new in _diagonals(a[at], b[at]):
            if d in ending:
                out[s + ending[d]] = new[row[at][ending[d]], ending[d]]
    return out


def soft_dtw_pairs(a: np.ndarray, b: np.ndarray, gamma: float, na: np.ndarray | None = None, nb: np.ndarray | None = None) -> np.ndarray:
    """Soft-DTW (squared costs, soft minimum of temperature ``gamma``) of paired rows; plain squared DTW for 0.

    Rows may be padded: then ``na`` and ``nb`` are their true lengths. What lies
    behind a row's end never enters its own result.
    """
    ends = _ends(a, b, na, nb)
    out = np.empty(len(a))
    for s in range(0, len(a), WARP_ROWS):
        at = slice(s, s + WARP_ROWS)
        row, last, value = ends[0][at], ends[1][at], out[at]
        for d, new in enumerate(_soft_diagonals(a[at], b[at], gamma, last.max())):
            here = np.flatnonzero(last == d)
            value[here] = new[row[here], here]
    return out


def _ends(a, b, na, nb):
    """Stored row and diagonal of each pair's last cell."""
    na = np.full(len(a), a.shape[1]) if na is None else na
    nb = np.full(len(b), b.shape[1]) if nb is None else nb
    return na, na + nb - 2


def _soft_diagonals(a: np.ndarray, b: np.ndarray, gamma: float, last: int):
    """Accumulated cost of the cells of each anti-diagonal up to ``last``.

    Row i + 1 holds cell (i, s - i) of all pairs. The rows next to the outermost
    cells are infinite; rows further out are never read.
    """
    n, la = a.shape
    lb = b.shape[1]
    across, back = np.ascontiguousarray(a.T), np.ascontiguousarray(b[:, ::-1].T)
    older = old = np.full((la + 2, n), np.inf)
    for s in range(last + 1):
        lo, hi = max(0, s - lb + 1), min(la - 1, s)
        new = np.empty((la + 2, n))
        new[[lo, hi + 2]] = np.inf
        inner = new[lo + 1 : hi + 2]
        if s == 0:
            inner[:] = 0
        else:
            _soft_minimum(old[lo + 1 : hi + 2], old[lo : hi + 1], older[lo : hi + 1], gamma, inner)
        cost = across[lo : hi + 1] - back[lb - 1 - s + lo : lb - s + hi]
        np.multiply(cost, cost, out=cost)
        inner += cost
        yield new
        older, old = old, new


def _soft_minimum(x, y, z, gamma, out) -> None:
    """-gamma log(e^(-x/gamma) + e^(-y/gamma) + e^(-z/gamma)); logarithms only where a second term counts."""
    least = np.minimum(x, y)
    np.minimum(least, z, out=out)
    if gamma:
        others = np.maximum(least, z), np.maximum(x, y)
        close = np.flatnonzero(np.minimum(*others) - out < SOFT_FAR * gamma)
        if len(close):
            flat = out.reshape(-1)
            low = flat[close]
            rest = sum(np.exp((low - o.reshape(-1)[close]) / gamma) for o in others)
            flat[close] = low - gamma * np.log1p(rest)


def soft_alignment(a: np.ndarray, b: np.ndarray, gamma: float, na: np.ndarray | None = None, nb: np.ndarray | None = None):
    """Pull of each row of ``a`` on the positions of its row of ``b``: soft-DTW, weights, weighted sums.

    The weight of position i of ``a`` at position j of ``b`` is the share of
    alignments through (i, j), the derivative of soft-DTW by that cell's cost:
    forward accumulation, then backward along the diagonals, both over the cells
    that can carry a share above rounding (``_warp_cells``).
    """
    row, last = _ends(a, b, na, nb)
    values, weights, sums = np.empty(len(a)), np.zeros(b.shape), np.zeros(b.shape)
    if not len(a):
        return values, weights, sums
    slack = SOFT_FAR * gamma + soft_slack(a.shape[1], b.shape[1], gamma)
    x, y, error = single(a, b, row, last + 2 - row)
    if not error(0.0) <= slack:
        x, y, error = a, b, lambda value: 1e-9 * value
    cells = (a.shape[1] + b.shape[1]) * (a.shape[1] + 2)  # kept for one pair
    step = max(1, min(len(a), WARP_PAIRS, WARP_STORED // (cells * x.itemsize)))
    stored = np.empty(cells * -(-step // WARP_ROWS) * WARP_ROWS, x.dtype)  # every slice writes it again
    found, held, start = [], 0, 0
    for s in range(0, len(a), step):
        at = slice(s, s + step)
        d, i, p = _warp_cells(x[at], y[at], row[at], last[at], slack, error, stored)
        found.append((d, i, p + s - start))
        held += len(d)
        end = min(s + step, len(a))
        if held >= WARP_USED or end == len(a):
            part = slice(start, end)
            order = np.argsort(np.concatenate([f[0] for f in found]), kind="stable")
            used = [np.concatenate([f[k] for f in found])[order] for k in range(3)]
            values[part], weights[part], sums[part] = _shares(a[part], b[part], gamma, row[part], last[part], *used)
            found, held, start = [], 0, end
    return values, weights, sums


def _warp_cells(a, b, row, last, slack, error, stored):
    """Diagonal, position in ``a`` and pair of all cells on a path whose cost is within ``slack`` of the least.

    All paths through any other cell together carry a share below e^-40: their
    number is bounded by ``soft_slack``. ``error`` is that of a path's cost by its
    value. Diagonals rise.
    """
    n, size = len(a), last.max() + 1
    wide = (a.shape[1] + 2) * WARP_ROWS
    cube = stored[: -(-n // WARP_ROWS) * size * wide].reshape(-1, size, a.shape[1] + 2, WARP_ROWS)
    for g, kept in enumerate(cube):  # so many pairs that a diagonal stays in cache
        at = slice(g * WARP_ROWS, (g + 1) * WARP_ROWS)
        sweep = _diagonals(a[at], b[at], kept[:, :, : len(a[at])])
        for _ in range(size):
            next(sweep)
    group, within = np.divmod(np.arange(n), WARP_ROWS)
    final = group * (size * wide) + row * WARP_ROWS + within
    slack = slack + 3 * error(slack + stored[final + last * wide].max())
    starts = {d: final[last == d] for d in np.unique(last)}
    none = np.empty(0, dtype=int), np.empty(0)
    out, now, then = [], [none], [none]  # cells of this diagonal and of the one before: place, cost above the least
    for d in range(size - 1, -1, -1):
        if d in starts:
            now.append((starts[d], np.zeros(len(starts[d]))))
        place, above = (np.concatenate(v) for v in zip(*now))
        near = np.flatnonzero(above <= slack)
        place, above = place.take(near), above.take(near)
        order = np.lexsort((above, place))
        place, above = place.take(order), above.take(order)
        first = np.ones(len(place), bool)
        np.not_equal(place[1:], place[:-1], out=first[1:])
        place, above = place[first], above[first]
        out.append(place)
        if d:
            # places beside a diagonal are infinite there
            before = place + (d - 1) * wide
            left, up = stored.take(before), stored.take(before - WARP_ROWS)
            both = stored.take(before - wide - WARP_ROWS) if d > 1 else np.full(len(place), np.inf)
            above = above - np.minimum(np.minimum(left, up), both)
            now = [*then, (place, above + left), (place - WARP_ROWS, above + up)]
            then = [(place - WARP_ROWS, above + both)]
    group, place = np.divmod(np.concatenate(out[::-1]), size * wide)
    i, within = np.divmod(place, WARP_ROWS)
    return np.repeat(np.arange(size), [len(v) for v in out[::-1]]), i - 1, group * WARP_ROWS + within


def _shares(a, b, gamma, row, last, d, i, p):
    """Soft-DTW, weights and weighted sums over the given cells, sorted by diagonal."""
    n = len(a)
    j, place = d - i, (i + 1) * n + p
    own = a[p, i]
    cost = (own - b[p, j]) ** 2
    ends = np.searchsorted(d, np.arange(last.max() + 2))
    final = row * n + np.arange(n)
    values, parts, share = np.empty(n), np.empty((3, len(d))), np.empty(len(d))
    newest, old, older = (np.full((a.shape[1] + 2) * n, np.inf) for _ in range(3))
    for s in range(len(ends) - 1):
        at = slice(ends[s], ends[s + 1])
        here = place[at]
        if s:
            before = np.stack([old.take(here), old.take(here - n), older.take(here - n)])
            least = before.min(axis=0)
            terms = np.exp((least - before) / gamma)
            total = terms.sum(axis=0)
            parts[:, at] = terms / total
            newest[here] = least - gamma * np.log(total) + cost[at]
        else:
            parts[:, at] = 0
            newest[here] = cost[at]
        done = np.flatnonzero(last == s)
        values[done] = newest[final[done]]
        if s > 1:
            older[place[ends[s - 2] : ends[s - 1]]] = np.inf
        newest, old, older = older, newest, old
    newest, old, older = (np.zeros((a.shape[1] + 2) * n) for _ in range(3))
    for s in range(len(ends) - 2, -1, -1):
        at = slice(ends[s], ends[s + 1])
        here = place[at]
        newest[final[last == s]] = 1
        share[at] = carried = newest.take(here)
        left, up, both = parts[:, at] * carried
        old[here] += left
        old[here - n] += up
        older[here - n] += both
        newest[:] = 0
        newest, old, older = old, older, newest
    at, size = p * b.shape[1] + j, b.shape[0] * b.shape[1]
    return values, np.bincount(at, share, size).reshape(b.shape), np.bincount(at, share * own, size).reshape(b.shape)


def soft_slack(na, nb, gamma: float):
    """Most by which soft-DTW lies below squared DTW: the logarithm of a bound on the number of alignments."""
    return gamma * (na + nb) * np.log(1 + np.sqrt(2))


def by_lengths(xs: pd.Series, ys: pd.Series, kernel) -> pd.Series:
    """Apply a paired kernel to arrays of mixed lengths, one call per length combination."""
    out = np.full(len(xs), np.nan)
    known = (xs.notna() & ys.notna()).to_numpy()
    sizes = pd.DataFrame({
        "x": xs.map(lambda v: 0 if v is None else len(v)).to_numpy(),
        "y": ys.map(lambda v: 0 if v is None else len(v)).to_numpy(),
    })
    for (lx, ly), at in sizes[known].groupby(["x", "y"]).indices.items():
        rows = np.flatnonzero(known)[at]
        if lx and ly:
            out[rows] = kernel(np.stack(xs.iloc[rows].to_numpy()), np.stack(ys.iloc[rows].to_numpy()))
    return pd.Series(out)


def _paired(kernel, a, b) -> Column:
    """A kernel over two array columns as an Arrow function: values are read in place, per length combination."""

    @F.arrow_udf("double")
    def apply(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.full(len(x), np.nan)
        starts, sizes, flat = [], [], []
        for side in (x, y):
            offsets = side.offsets.to_numpy()
            starts.append(offsets[:-1])
            sizes.append(np.where(side.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets)))
            flat.append(side.values.to_numpy(zero_copy_only=False))
        for lx, ly in np.unique(np.stack(sizes, axis=1), axis=0):
            rows = np.flatnonzero((sizes[0] == lx) & (sizes[1] == ly))
            if lx and ly:
                p, q = (f[s[rows][:, None] + np.arange(n)] for f, s, n in zip(flat, starts, (lx, ly)))
                out[rows] = kernel(p, q)
        return pa.array(out, mask=np.isnan(out))

    # non-deterministic only so that a filter on the result does not evaluate it twice
    return apply.asNondeterministic()(a, b)


def dtw(a, b) -> Column:
    """Dynamic-time-warping distance of two array columns; lengths may differ."""
    return _paired(dtw_pairs, a, b)


def dtw_below(a, b, radius: float) -> Column:
    """DTW distance where it is below ``radius``, else null."""
    return _paired(lambda p, q: dtw_pairs_below(p, q, radius), a, b)


def soft_dtw(a, b, gamma: float = 1.0) -> Column:
    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return by_lengths(x, y, lambda p, q: soft_dtw_pairs(p, q, gamma))

    return distance(a, b)


def lowpass(values: np.ndarray, divisor: int) -> np.ndarray:
    """Keep the first ``n div divisor`` spectrum coefficients of each row only; magnitude of the inverse."""
    spectrum = np.fft.fft(values)
    spectrum[..., values.shape[-1] // divisor :] = 0
    return np.abs(np.fft.ifft(spectrum))


# fixed values: db3 analysis low-pass filter
DB3 = (
    0.035226291882100656, -0.08544127388224149, -0.13501102001039084,
    0.4598775021193313, 0.8068915093133388, 0.3326705529509569,
)


def dwt_step(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One db3 analysis step of each row with half-sample symmetric padding: approximation, detail."""
    low = np.array(DB3)
    high = low[::-1] * np.where(np.arange(len(low)) % 2 == 0, -1.0, 1.0)
    edges = [(0, 0)] * (values.ndim - 1) + [(len(low) - 1,) * 2]
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(values, edges, mode="symmetric"), len(low), axis=-1)
    return tuple(frames[..., 1::2, :] @ f[::-1] for f in (low, high))


def spectrogram(values: np.ndarray, window: int = 256, overlap: int = 32, taper: float = 0.25):
    """One-sided power density of overlapping mean-free Tukey windows of each row: f, t, power[..., f, t]."""
    n = values.shape[-1]
    if n < window:
        window, overlap = n, n // 8
    at = np.arange(window) / window  # periodic window
    edge = np.minimum(at, 1 - at)
    weight = np.where(edge < taper / 2, 0.5 * (1 - np.cos(2 * np.pi * edge / taper)), 1.0)
    frames = np.lib.stride_tricks.sliding_window_view(values, window, axis=-1)[..., :: window - overlap, :]
    frames = (frames - frames.mean(axis=-1, keepdims=True)) * weight
    power = np.abs(np.fft.rfft(frames)) ** 2 / (weight**2).sum()
    power[..., 1 : (window + 1) // 2] *= 2
    times = window / 2 + np.arange(frames.shape[-2]) * (window - overlap)
    return np.fft.rfftfreq(window), times, np.swapaxes(power, -1, -2)


def scalogram(values: np.ndarray, voices: int = 4, omega: float = 6.0):
    """Morlet wavelet magnitudes of each row on log2-spaced scales: scales, magnitude[..., scale, t]."""
    n = values.shape[-1]
    octaves = max(1, int(np.log2(max(n, 4))) - 1)
    scales = 2.0 ** (1 + np.arange(octaves * voices) / voices)
    padded = 1 << int(np.ceil(np.log2(2 * n)))
    spectrum = np.fft.fft(values - values.mean(axis=-1, keepdims=True), padded)
    w = 2 * np.pi * np.fft.fftfreq(padded)
    wavelet = np.pi**-0.25 * np.exp(-0.5 * (scales[:, None] * w - omega) ** 2) * (w > 0)
    return scales, np.abs(np.fft.ifft(spectrum[..., None, :] * wavelet))[..., :n]


def _unit_windows(values: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Length-m windows, z-normalised, and whether each is constant."""
    frames = np.lib.stride_tricks.sliding_window_view(values, m)
    dev = frames.std(axis=1)
    flat = dev == 0
    return (frames - frames.mean(axis=1, keepdims=True)) / np.where(flat, 1, dev)[:, None], flat


def profile_tile(a: np.ndarray, b: np.ndarray, m: int, at_a: int, at_b: int):
    """Nearest z-normalised neighbours between the windows of two slices of one series.

    ``at_a`` and ``at_b`` are the slices' first positions. Windows closer than or
    at ``ceil(m/4)`` are excluded. Two constant windows are at distance 0, a
    constant and a varying one at sqrt(m); windows with unknown values have no
    neighbour. Returns distance and position for the windows of a, then of b.
    """
    (p, flat_p), (q, flat_q) = _unit_windows(a, m), _unit_windows(b, m)
    square = np.maximum(2 * (m - p @ q.T), 0)
    square[flat_p[:, None] != flat_q[None, :]] = m
    square[flat_p[:, None] & flat_q[None, :]] = 0
    zone = -(-m // 4)
    if abs(at_a - at_b) <= max(len(p), len(q)) + zone:
        square[np.abs(at_a + np.arange(len(p))[:, None] - at_b - np.arange(len(q))[None, :]) <= zone] = np.inf
    square[np.isnan(square)] = np.inf
    near_p, near_q = square.argmin(axis=1), square.argmin(axis=0)
    return np.sqrt(square[np.arange(len(p)), near_p]), at_b + near_p, np.sqrt(square[near_q, np.arange(len(q))]), at_a + near_q


def matrix_profile(values: np.ndarray, m: int):
    """Distance to and position (or -1) of each window's nearest neighbour, as ``profile_tile`` of a whole series."""
    if len(values) < m:
        return np.empty(0), np.empty(0, dtype=np.int64)
    best, where, _, _ = profile_tile(values, values, m, 0, 0)
    return best, np.where(np.isfinite(best), where, -1)


def lag_products(values: np.ndarray, length: int, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of outer products of the first ``windows`` windows, without forming any.

    Entry (a, a + lag) is a stretch of the series' products at that lag, so one
    running sum per lag serves all a.
    """
    used = values[: windows + length - 1]
    running = lambda x: np.concatenate([[0.0], np.cumsum(x)])
    total = running(used)
    outer = np.zeros((length, length))
    for lag in range(length):
        a = np.arange(length - lag)
        sums = running(used[: len(used) - lag] * used[lag:])
        outer[a, a + lag] = outer[a + lag, a] = sums[a + windows] - sums[a]
    a = np.arange(length)
    return total[a + windows] - total[a], outer


MINING, THEFT, UNUSABLE = 1, 2, 4


def _plain_events(usage, window, std, m, n, floor) -> np.ndarray:
    """For positions from ``window`` on: a breach of the plain previous window with n confirmations."""
    frames = np.lib.stride_tricks.sliding_window_view(usage, window)[:-1]
    here = usage[window:]
    if window < 2 or m < n:
        return np.zeros(len(here), bool)
    mean, dev = frames.mean(axis=1), frames.std(axis=1, ddof=1)
    upper, lower = mean + std * dev, mean - std * dev
    # compared with slack: this only preselects positions, the scan decides
    slack = 1e-9 * (np.abs(mean) + dev + 1)
    nxt = np.lib.stride_tricks.sliding_window_view(np.concatenate([here[1:], np.full(m, np.nan)]), m)[: len(here)]
    up = (here > upper - slack) & (((nxt > (upper - slack)[:, None]) & (nxt > floor)).sum(axis=1) >= n)
    down = (here < lower + slack) & ((nxt < (lower + slack)[:, None]).sum(axis=1) >= n)
    return up | down


def _run_length(ahead, bound, sign, least, m, n) -> int:
    """Smallest step whose m buckets hold fewer than n confirmations."""
    first = ahead[:m]
    if np.count_nonzero((sign * (first - bound) > 0) & (first > least)) < n:
        return 1
    total = np.concatenate([[0], np.cumsum((sign * (ahead - bound) > 0) & (ahead > least))])
    counts = total[np.minimum(np.arange(len(total)) + m, len(total) - 1)] - total
    return 1 + int(np.flatnonzero(counts < n)[0])


def scan_events(usage: np.ndarray, window: int, std: float, m: int, n: float, floor: float) -> np.ndarray:
    """Bit flags per bucket of confirmed high (1) and low (2) runs and of excluded buckets (4).

    A breach of the band of the first ``window`` usable buckets from
    ``start - window`` on is confirmed while at least ``n`` of the next ``m``
    buckets breach it too; then its buckets are flagged, excluded from later
    bands, and the scan moves past the run plus one window.
    """
    size = len(usage)
    high = np.zeros(size, bool)
    low = np.zeros(size, bool)
    usable = np.ones(size, bool)
    if size > window:
        plain = _plain_events(usage, window, std, m, n, floor)
        start, dirty = window, 0  # dirty: first position whose whole window is usable again
        while start < size:
            if start >= dirty:
                ahead = np.flatnonzero(plain[start - window :])
                if not len(ahead):
                    break
                start += int(ahead[0])
            reach = start + window
            picked = np.flatnonzero(usable[start - window : reach])
            while len(picked) < window and reach < size:
                reach = min(size, reach + 4 * window)
                picked = np.flatnonzero(usable[start - window : reach])
            base = usage[start - window + picked[:window]]
            step = 1
            if len(base) >= 2:
                mean, dev = base.mean(), base.std(ddof=1)
                if usage[start] > mean + std * dev:
                    flags, bound, sign, least = high, mean + std * dev, 1, floor
                elif usage[start] < mean - std * dev:
                    flags, bound, sign, least = low, mean - std * dev, -1, -np.inf
                else:
                    start += 1
                    continue
                step = _run_length(usage[start + 1 :], bound, sign, least, m, n)
                if step > 1:
                    run = slice(start + 1, start + step + m)
                    flags[run] = sign * (usage[run] - bound) > 0
                    usable[run] = sign * (usage[run] - bound) < 0
                    dirty = start + step + m + window
                    start += window + step
            start += 1
    return high * MINING + low * THEFT + (~usable) * UNUSABLE

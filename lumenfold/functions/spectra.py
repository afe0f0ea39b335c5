"""Spectra of one signal: power density, fits and diagnostics, on numpy arrays.

These run inside Arrow-batched functions, one call for each signal or window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TINY = np.nextafter(0.0, 1.0)
FIT_RANGE = (100.0, 8000.0)


def half_up(x):
    return np.floor(np.asarray(x) + 0.5).astype(np.int64)


def frame_starts(n: int, size: int, overlap: float = 0.5, budget: int | None = None) -> np.ndarray:
    """Starts of whole frames; with a budget, evenly spaced ones with both ends, or the middle one."""
    hop = max(1, int(half_up(size * (1 - overlap))))
    available = (n - size) // hop + 1 if n >= size else 0
    if available <= 0:
        return np.zeros(0, np.int64)
    wanted = min(available, budget or available)
    if wanted == 1:
        return np.array([(available - 1) // 2 * hop], np.int64)
    return half_up(np.arange(wanted) * (available - 1) / (wanted - 1)) * hop


def frame_size(n: int, requested: int = 4096) -> int:
    power = lambda v: 1 << (max(1, int(v)).bit_length() - 1)
    return max(256, min(power(requested), power(n)))


def welch(samples: np.ndarray, rate: float, requested: int = 4096, overlap: float = 0.5, budget: int | None = 48) -> tuple[np.ndarray, np.ndarray, int]:
    """Frequencies, one-sided power density and frames used; empty for under 256 samples or no rate."""
    x = np.asarray(samples, np.float64)
    if len(x) < 256 or not (rate > 0 and np.isfinite(rate)):
        return np.zeros(0), np.zeros(0), 0
    size = frame_size(len(x), requested)
    frames = x[frame_starts(len(x), size, overlap, budget)[:, None] + np.arange(size)]
    window = np.hanning(size)
    frames = (frames - frames.mean(1, keepdims=True)) * window
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 / (rate * np.square(window).sum())
    power[:, 1:-1] *= 2
    return np.arange(size // 2 + 1) * rate / size, np.maximum(power.mean(0), TINY), len(frames)


def shaped(noise: np.ndarray, beta: float, size: int = 4096) -> np.ndarray:
    """Noise filtered to a power of f ** -beta, without the size // 2 samples at each end that only fill the filter."""
    freq = np.maximum(1, np.arange(size // 2 + 1)) / (size // 2)
    taps = np.roll(np.fft.irfft(freq ** (-beta / 2), size), size // 2) * np.hanning(size + 1)[:size]
    length = 1 << (len(noise) + size - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(noise, length) * np.fft.rfft(taps, length), length)[size : len(noise)]


def in_range(freq: np.ndarray, power: np.ndarray, low: float, high: float) -> np.ndarray:
    inside = (freq >= low) & (freq <= high) & (power > 0) & np.isfinite(power)
    inside[:1] = False
    return inside


@dataclass
class Fit:
    """log10 power against log10 frequency; beta is the negative slope."""

    beta: float = np.nan
    intercept: float = np.nan
    r2: float = 0.0
    rmse_db: float = np.inf
    mae_db: float = np.inf
    points: int = 0


def power_law(freq: np.ndarray, power: np.ndarray, low: float = FIT_RANGE[0], high: float = FIT_RANGE[1]) -> Fit:
    use = in_range(freq, power, low, high)
    n = int(use.sum())
    if n < 8:
        return Fit(points=n)
    x, y = np.log10(freq[use]), np.log10(power[use])
    dx, dy = x - x.mean(), y - y.mean()
    slope = (dx @ dy) / (dx @ dx)
    intercept = y.mean() - slope * x.mean()
    rest = y - intercept - slope * x
    total = dy @ dy
    r2 = min(1.0, max(0.0, 1 - (rest @ rest) / total)) if total > 0 else 0.0
    return Fit(-slope, intercept, r2, 10 * np.sqrt(rest @ rest / n), float(np.abs(10 * rest).mean()), n)


def flatness(power: np.ndarray) -> float:
    """Geometric over arithmetic mean; 0 for nothing."""
    p = np.maximum(power, TINY)
    return float(np.exp(np.log(p).mean()) / p.mean()) if len(p) else 0.0


def log_binned(freq: np.ndarray, power: np.ndarray, low: float, high: float, bins: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Median log10 power in equal buckets of log frequency, at their centres; empty ones left out."""
    use = in_range(freq, power, low, high)
    x, y = np.log10(freq[use]), np.log10(power[use])
    a, b = np.log10(low), np.log10(high)
    bucket = np.clip(np.floor((x - a) / (b - a) * bins).astype(int), 0, bins - 1)
    order = np.lexsort((y, bucket))
    there, first, count = np.unique(bucket[order], return_index=True, return_counts=True)
    level = (y[order[first + (count - 1) // 2]] + y[order[first + count // 2]]) / 2
    return a + (there + 0.5) * (b - a) / bins, level


def _solve(basis: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray | None, float]:
    """Weighted least squares by orthogonalisation, and how new the least new column was; None if one was not."""
    root = np.sqrt(weight)
    n, m = basis.shape
    q, r, least = np.zeros((n, m)), np.zeros((m, m)), 1.0
    for j in range(m):
        v = basis[:, j] * root
        norm = np.linalg.norm(v)
        for _ in range(2):
            part = q[:, :j].T @ v
            r[:j, j] += part
            v = v - q[:, :j] @ part
        r[j, j] = np.linalg.norm(v)
        novelty = r[j, j] / max(norm, TINY)
        if not novelty >= 1e-5:
            return None, 0.0
        least = min(least, novelty)
        q[:, j] = v / r[j, j]
    return np.linalg.solve(r, q.T @ (y * root)), least


@dataclass
class Robust:
    """A Huber regression: coefficients, residuals, the weights of the last solve, the least novelty of a column."""

    coefficients: np.ndarray
    rest: np.ndarray
    weights: np.ndarray
    novelty: float

    @property
    def squares(self) -> float:
        return float(self.rest @ self.rest)

    @property
    def rmse_db(self) -> float:
        return 10 * float(np.sqrt(self.squares / len(self.rest)))

    @property
    def mad_db(self) -> float:
        return 10 * deviation(self.rest)


def deviation(values: np.ndarray) -> float:
    """The median distance from the median, scaled to a standard deviation."""
    return 1.4826 * float(np.median(np.abs(values - np.median(values))))


def robust(basis: np.ndarray, y: np.ndarray, turns: int = 5) -> Robust | None:
    """Reweighted least squares; None for too few points or columns that aren't independent."""
    if len(y) < basis.shape[1] + 2:
        return None
    weight, least, out = np.ones(len(y)), 1.0, None
    for _ in range(turns):
        coefficients, novelty = _solve(basis, y, weight)
        if coefficients is None:
            return None
        least = min(least, novelty)
        out = Robust(coefficients, y - basis @ coefficients, weight, least)
        scale = deviation(out.rest)
        if not scale > 1e-9:
            break
        far = np.abs(out.rest - np.median(out.rest))
        weight = np.minimum(1.0, 1.5 * scale / np.maximum(far, np.finfo(float).eps))
    return out


def medians(values: np.ndarray) -> np.ndarray:
    """The median of each row of finite numbers, as a column."""
    ranked, n = np.sort(values, axis=1), values.shape[1]
    return (ranked[:, [(n - 1) // 2]] + ranked[:, [n // 2]]) / 2


@dataclass
class Fits:
    """robust() of many bases: which have a fit, the last coefficient, the residuals, the weights and the novelty of each."""

    good: np.ndarray
    last: np.ndarray
    rest: np.ndarray
    weights: np.ndarray
    novelty: np.ndarray


def robust_each(bases: np.ndarray, y: np.ndarray, turns: int = 5) -> Fits:
    """robust() of bases (fit, point, column) at once, by a stacked QR; rows of fits that are none hold zeros."""
    k, n, m = bases.shape
    out = Fits(np.zeros(k, bool), np.zeros(k), np.zeros((k, n)), np.ones((k, n)), np.ones(k))
    if n < m + 2:
        return out
    out.good[:] = True
    going, weight = np.arange(k), np.ones((k, n))
    for _ in range(turns):
        if not len(going):
            break
        root = np.sqrt(weight)
        scaled = bases[going] * root[:, :, None]
        norms = np.sqrt(np.einsum("knm,knm->km", scaled, scaled))
        q, r = np.linalg.qr(scaled)
        own = np.abs(np.diagonal(r, axis1=1, axis2=2)) / np.maximum(norms, TINY)
        fine = (own >= 1e-5).all(1)
        out.good[going[~fine]] = False
        going, weight, root, q, r, own = going[fine], weight[fine], root[fine], q[fine], r[fine], own[fine]
        coefficients = np.linalg.solve(r, np.einsum("knm,kn->km", q, root * y)[:, :, None])[:, :, 0]
        rest = y - np.einsum("knm,km->kn", bases[going], coefficients)
        out.last[going], out.rest[going], out.weights[going] = coefficients[:, -1], rest, weight
        out.novelty[going] = np.minimum(out.novelty[going], own.min(1))
        far = np.abs(rest - medians(rest))
        scale = 1.4826 * medians(far)
        on = scale[:, 0] > 1e-9
        going, far, scale = going[on], far[on], scale[on]
        weight = np.minimum(1.0, 1.5 * scale / np.maximum(far, np.finfo(float).eps))
    return out


def line(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, intercept and sum of squares of a straight line; NaN and infinite for under 4 points or one x."""
    dx = x - x.mean() if len(x) else x
    if len(x) < 4 or not dx @ dx > 0:
        return np.nan, np.nan, np.inf
    slope = float(dx @ (y - y.mean()) / (dx @ dx))
    rest = y - y.mean() - slope * dx
    return slope, float(y.mean() - slope * x.mean()), float(rest @ rest)


def _effective(weights: np.ndarray) -> float:
    return float(weights.sum() ** 2 / max(np.square(weights).sum(), TINY))


def adequacy(freq: np.ndarray, power: np.ndarray, low: float = FIT_RANGE[0], high: float = FIT_RANGE[1]) -> dict:
    """Whether one power law describes a spectrum: smooth departures and slope changes of its log-binned shape.

    A slope change is a hinge between two bins. Plain ones are judged against
    the straight line (delta, improvement, relative, evidence), adjusted ones
    against a smooth curve of degree five (abrupt_...), if they can be told from
    it. Of each kind the one with the most evidence is kept.
    """
    x, y = log_binned(freq, power, low, high)
    n, inf = len(x), float("inf")
    slope, _, squares = line(x, y)
    half = n // 2
    out = dict(smooth_db=inf, smooth_rmse_db=inf, smooth_mad_db=inf, slope_low=line(x[:half], y[:half])[0], slope_high=line(x[half:], y[half:])[0])
    kinds = ("delta", "improvement", "relative", "evidence", "support")
    out |= {k: 0.0 for k in kinds} | {f"abrupt_{k}": 0.0 for k in kinds} | dict(break_hz=np.nan, abrupt_hz=np.nan, rejected=0)
    cuts = np.arange(7, n - 1)
    if not np.isfinite(slope):
        return out
    powers = np.stack([(x - x.mean()) ** k for k in range(6)], 1)
    smooth = robust(powers, y)
    if smooth:
        curve = y - smooth.rest
        tilt, offset, _ = line(x, curve)
        out |= dict(smooth_db=10 * float(np.ptp(curve - offset - tilt * x)), smooth_rmse_db=smooth.rmse_db, smooth_mad_db=smooth.mad_db)
    at = (x[cuts - 1] + x[cuts]) / 2
    hinges = np.maximum(0.0, x[:, None] - at)
    dx = x - x.mean()
    own = hinges - hinges.mean(0) - dx[:, None] * (dx @ hinges) / (dx @ dx)  # what of each hinge is no straight line
    energy = np.square(own).sum(0)
    usable = energy > np.finfo(float).eps
    plain = np.where(usable, y @ own / np.where(usable, energy, 1), 0.0)
    rmse = lambda sse: 10 * np.sqrt(np.maximum(sse, 0) / n)
    both = robust_each(np.concatenate([np.broadcast_to(powers, (len(cuts), n, 6)), hinges.T[:, :, None]], 2), y) if smooth else None
    after_both = np.einsum("kn,kn->k", both.rest, both.rest) if both else None
    for i, cut in enumerate(cuts.tolist()):
        support = min(cut, n - cut)

        def judged(prefix: str, delta: float, before: float, after: float) -> None:
            relative = max(0.0, 1 - after / before) if before > 0 else 0.0
            evidence = delta * relative * np.sqrt(support)
            if evidence > out[f"{prefix}evidence"]:
                found = (delta, float(rmse(before) - rmse(after)), relative, float(evidence), float(support))
                out.update({f"{prefix}{k}": v for k, v in zip(kinds, found)})
                out[f"{prefix or 'break_'}hz"] = float(10 ** at[i])

        if usable[i]:
            judged("", abs(float(plain[i])), squares, squares - float(plain[i]) ** 2 * float(energy[i]))
        if not smooth:
            continue
        octaves = min(at[i] - x[0], x[-1] - at[i]) / np.log10(2)
        if not both.good[i] or support < 3 or min(_effective(both.weights[i, :cut]), _effective(both.weights[i, cut:])) < 2.5 or octaves < 0.25 or both.novelty[i] < 0.01:
            out["rejected"] += 1
            continue
        delta = abs(float(both.last[i]))
        if delta / max(0.5, abs(float(plain[i]))) > 3:  # the curve takes back what the hinge adds
            out["rejected"] += 1
            continue
        judged("abrupt_", delta, smooth.squares, float(after_both[i]))
    return out


def neighbourhood_floor(values: np.ndarray, reach: int = 18, gap: int = 3) -> np.ndarray:
    """Median of the neighbours up to reach away, without those within gap; NaN where there are none."""
    padded = np.pad(values, reach, constant_values=np.nan)
    offsets = np.array([d for d in range(-reach, reach + 1) if abs(d) > gap])
    near = padded[np.arange(len(values))[:, None] + reach + offsets]
    ranked, count = np.sort(near, axis=1), (~np.isnan(near)).sum(1)  # NaN comes last
    row, count = np.arange(len(values)), np.maximum(count, 1)
    return (ranked[row, (count - 1) // 2] + ranked[row, count // 2]) / 2


def strongest_apart(place: np.ndarray, strength: np.ndarray, reach: int = 10) -> np.ndarray:
    """Of peaks at places those that no stronger kept one is within reach of, by index; of equals the lower place goes first."""
    kept: list[int] = []
    for i in np.lexsort((place, -strength)).tolist():
        if all(abs(place[i] - place[k]) > reach for k in kept):
            kept.append(i)
    return np.array(sorted(kept, key=lambda i: place[i]), int)


def harmonics(tones: np.ndarray, step: float, most: int = 12) -> int:
    """The most tones that are multiples of one base of at least 40 Hz, a tone over 1 to most."""
    best = 0
    for base in (tones[:, None] / np.arange(1, most + 1)).ravel():
        if base >= 40:
            number = half_up(tones / base)
            good = (number >= 1) & (number <= most)
            number = np.maximum(number, 1)
            best = max(best, int((good & (np.abs(tones / base - number) / number <= np.maximum(0.018, 2 * step / tones))).sum()))
    return best


def tonality(freq: np.ndarray, power: np.ndarray, fit: Fit, low: float = FIT_RANGE[0], high: float = FIT_RANGE[1], earlier: list[float] | None = None) -> dict:
    """Peaks over the fitted law: how prominent, how much of the power, persistent, in harmonic relation.

    Without a fit the power itself is looked at. Fewer than 16 bins have no tones.
    """
    none = dict(prominence_db=0.0, tonal_ratio=0.0, peaks=[], persistent=0, harmonic_peaks=0, normalized_flatness=0.0, occupancy=0.0, harmonic_evidence=0.0)
    use = in_range(freq, power, low, high)
    if use.sum() < 16:
        return none
    at = np.flatnonzero(use)
    begin, f = at[0], freq[use]
    law = np.maximum(10 ** (fit.intercept - fit.beta * np.log10(f)), TINY) if np.isfinite(fit.beta) else np.ones(len(f))
    ratio = np.zeros(at[-1] - begin + 1)
    ratio[at - begin] = np.maximum(power[use] / law, TINY)
    whole, values = ratio.sum(), ratio[at - begin]
    around = np.pad(ratio, 2, constant_values=-np.inf)
    highest = np.max([around[k : k + len(ratio)] for k in (0, 1, 3, 4)], axis=0)
    ground = neighbourhood_floor(np.where(ratio > 0, ratio, np.nan))
    tops = np.flatnonzero((ratio > highest) & (ratio > 0) & (ground > 0))
    prominence = 10 * np.log10(ratio[tops] / ground[tops])
    strong = prominence >= 10
    peak, height = tops[strong], prominence[strong]
    kept = strongest_apart(peak, height)
    peak, height = peak[kept], height[kept]
    excess = np.array([np.maximum(0.0, ratio[max(0, p - 2) : p + 3] - ground[p] * 10**0.8).sum() for p in peak])
    tones = freq[begin + peak[(height >= 15) & (excess / whole >= 0.001)]] if len(peak) else np.zeros(0)
    a, b = np.log10(low), np.log10(high)
    band = np.minimum(23, np.floor((np.log10(f) - a) / (b - a) * 24).astype(int))
    level = np.array([np.median(values[band == k]) for k in np.unique(band)])
    best = harmonics(tones, freq[1] - freq[0])
    persistent = sum(any(abs(x - g) <= max(12.0, 0.02 * g) for g in earlier or []) for x in tones.tolist())
    return dict(
        prominence_db=max(0.0, float(prominence.max())) if len(tops) else 0.0, tonal_ratio=float(min(1.0, excess.sum() / whole)), peaks=tones.tolist(), persistent=persistent, harmonic_peaks=best,
        normalized_flatness=flatness(values), occupancy=float((level >= level.max() / 100).mean()) if level.max() > 0 else 0.0, harmonic_evidence=float(min(1.0, best / len(tones))) if len(tones) else 0.0,
    )


def log_spaced_levels(frame: np.ndarray, rate: float, rows: int = 56) -> tuple[np.ndarray, np.ndarray]:
    """Log-spaced frequencies and the levels in dB of the nearest bins, but for the first, of one Hann frame of a power of two samples."""
    size = len(frame)
    power = np.abs(np.fft.rfft(frame * np.hanning(size))) ** 2
    freq = np.geomspace(80, min(12000, 0.48 * rate), rows)
    bins = np.clip(half_up(freq * size / rate), 1, size // 2)
    return freq, 10 * np.log10(np.maximum(power[bins], TINY))


def spectrogram(samples: np.ndarray, rate: float, most: int = 80, rows: int = 56) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, frequencies and levels in dB of strided half-overlapping frames of up to 2048 samples."""
    x = np.asarray(samples, np.float64)
    size = 1 << max(0, min(len(x), 2048).bit_length() - 1)
    starts = frame_starts(len(x), size) if len(x) >= 256 else np.zeros(0, int)
    if not len(starts):
        return np.zeros(0), np.zeros(0), np.zeros((0, rows))
    starts = starts[:: -(-len(starts) // most)]
    found = [log_spaced_levels(x[s : s + size], rate, rows) for s in starts]
    return (starts + size / 2) / rate, found[0][0], np.array([level for _, level in found])

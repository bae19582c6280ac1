"""Similarity transforms of samples from matched points, robust against wrong matches, and the last good one where none fits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import signal
from tidemark.sources.tables import ship

COEFFICIENTS = ("a", "b", "tx", "c", "d", "ty")


def _two_points(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Complex m and t with m * p + t = r and m * q + t = s; points are complex numbers."""
    with np.errstate(divide="ignore", invalid="ignore"):
        m = (s - r) / (q - p)
    return m, r - m * p


def similarity(source: np.ndarray, target: np.ndarray, seed: int, reach: float = 0.006, tries: int = 400, least_matches: int = 20, least_inliers: int = 15) -> tuple[complex, complex] | None:
    """m and t of target = m * source + t over complex numbers, by seeded consensus of pairs; None if too few points agree.

    The pair of points with the most others within reach wins, of equals the first drawn; least squares over those gives the
    result, once more over the ones that it brings within reach.
    """
    n = len(source)
    if n < least_matches:
        return None
    rng = np.random.default_rng(seed)
    i = rng.integers(0, n, tries)
    j = (i + rng.integers(1, n, tries)) % n
    m, t = _two_points(source[i], source[j], target[i], target[j])
    near = np.abs(m[:, None] * source[None, :] + t[:, None] - target[None, :]) <= reach
    best = near[int(near.sum(1).argmax())]
    for _ in range(2):
        if best.sum() < least_inliers:
            return None
        p, r = source[best], target[best]
        centre, to = p.mean(), r.mean()
        spread = (np.abs(p - centre) ** 2).sum()
        if spread == 0:
            return None
        m1 = ((r - to) * np.conj(p - centre)).sum() / spread
        t1 = to - m1 * centre
        best = np.abs(m1 * source + t1 - target) <= reach
    return complex(m1), complex(t1)


def fit(matches: DataFrame, keys: list[str], time: str, points: str = "points", scales: tuple[float, float] = (0.6, 1.6), most_shift: float = 0.5) -> DataFrame:
    """keys, time, a, b, tx, c, d, ty and good of each sample: x' = a x + b y + tx, y' = c x + d y + ty.

    points: an array of structs sx, sy, dx, dy in shares of the frame, the matches of one sample. A sample whose fit is null,
    scaled outside scales or shifted by more than most_shift isn't good and has the last good transform of its key, before
    the first one none at all. The draws of a sample are seeded by its key and time alone.
    """
    ship(matches.sparkSession)
    kept = [*keys, time]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], b.column(points)
            # the coordinates of all samples of a batch as one array, and where each sample's part begins
            flat, sizes = held.flatten(), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            every = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("sx", "sy", "dx", "dy")], axis=1)
            ends = np.cumsum(sizes)
            for names, end, size in zip(b.select(kept).to_pylist(), ends.tolist(), sizes.tolist(), strict=True):
                p = every[end - size : end]
                seed = int.from_bytes(hashlib.blake2b(repr([names[k] for k in kept]).encode(), digest_size=8).digest(), "little")
                found = similarity(p[:, 0] + 1j * p[:, 1], p[:, 2] + 1j * p[:, 3], seed)
                if found is None or not scales[0] < abs(found[0]) < scales[1] or abs(found[1].real) > most_shift or abs(found[1].imag) > most_shift:
                    out.append((None,) * 6)
                else:
                    m, t = found
                    out.append((m.real, -m.imag, t.real, m.imag, m.real, t.imag))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *(pa.array([o[i] for o in out], pa.float64()) for i in range(6))], [*kept, *(f"f_{c}" for c in COEFFICIENTS)])

    rows = matches.select(*kept, points)
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in kept), *(f"f_{c} double" for c in COEFFICIENTS)])
    fitted = rows.mapInArrow(run, schema)
    made = F.when(F.col("f_a").isNotNull(), F.struct(*(F.col(f"f_{c}").alias(c) for c in COEFFICIENTS)))
    carried = fitted.withColumn("_fit", made).withColumn("_last", signal.carry_forward("_fit", keys, [time]))
    return carried.select(*kept, *(F.col(f"_last.{c}").alias(c) for c in COEFFICIENTS), F.col("f_a").isNotNull().alias("good"))

"""Draws that repeat a 32-bit generator bit for bit, for results that must equal older ones.

A shuffle of this kind depends on the number and order of its items, so a group
is drawn in one task; use it where groups are of bounded size. Everything else
in this package orders by a hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: constants of the generator and of the seeds, default seeds ----
STEP, GOLDEN, FNV_START, FNV_PRIME = 0x6D2B79F5, 0x9E3779B1, 0x811C9DC5, 0x01000193
SEED, DATE_SEED, BINS = 20260916, 20260917, 4
# ---- end of the fixed values ----
_M = 0xFFFFFFFF


def numbers(seed: int, n: int) -> np.ndarray:
    """The first ``n`` numbers of the generator, in [0, 1).

    Its state is a counter, so all are computed at once, in 64 bits cut to 32.
    """
    mask = np.uint64(_M)
    a = (np.uint64(seed & _M) + np.uint64(STEP) * np.arange(1, n + 1, dtype=np.uint64)) & mask
    t = ((a ^ (a >> np.uint64(15))) * (a | np.uint64(1))) & mask
    t ^= (t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & mask)) & mask
    return (t ^ (t >> np.uint64(14))).astype(np.float64) / 2**32


def order(n: int, seed: int) -> np.ndarray:
    """Places of ``n`` items after the shuffle: swaps from the last item to the second."""
    out = np.arange(n)
    for r, i in zip(numbers(seed, max(0, n - 1)), range(n - 1, 0, -1), strict=True):
        j = int(r * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def bin_seed(seed: int, bin_: int, side: int) -> int:
    return (seed + (2 * bin_ + side + 1) * GOLDEN) & _M


def placebo_seed(seed: int) -> int:
    return (seed + (2 * BINS + 1) * GOLDEN) & _M


def group_seed(seed: int, group: str) -> int:
    """A seed mixed from a name's UTF-16 units."""
    units = np.frombuffer(group.encode("utf-16-le"), np.uint16)
    h = FNV_START
    for u in units:
        h = ((h ^ int(u)) * FNV_PRIME) & _M
    return (seed + h) & _M


def shuffled(rows: DataFrame, group: str, pos: str, seed: int = SEED) -> DataFrame:
    """``rows`` with ``rank``: the place of each in its group's shuffle, groups seeded by name, items in order of ``pos``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("rank", T.LongType())])

    def draw(key, part):
        part = part.sort_values(pos, kind="stable").reset_index(drop=True)
        part = part.iloc[order(len(part), group_seed(seed, str(key[0])))].copy()
        return part.assign(rank=np.arange(len(part)))

    return rows.groupBy(group).applyInPandas(draw, schema)


def sampled(rows: DataFrame, group: str, pos: str, n: int, seed: int = DATE_SEED) -> DataFrame:
    """The first ``n`` of each group's shuffle."""
    return shuffled(rows, group, pos, seed).where(F.col("rank") < n)

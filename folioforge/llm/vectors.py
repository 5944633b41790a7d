"""Vectors as rows of float64 matrices."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def finite_rows(column: Iterable) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which entries are vectors of finite numbers, at least one; and those, as float64."""
    good, rows = [], []
    for value in column:
        ok = False
        if value is not None and np.ndim(value) == 1 and len(value):
            try:
                row = np.asarray(value, np.float64)
                ok = bool(np.isfinite(row).all())
            except (TypeError, ValueError):
                ok = False
        good.append(ok)
        if ok:
            rows.append(row)
    return np.array(good, bool), rows

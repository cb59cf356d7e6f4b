"""Groups of long rows as matrices and back, for functions that Spark calls per group in Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(rows: pa.Table, row: str, column: str, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted row labels, sorted column labels and the matrix of values, NaN where there is none.
    Two values in one place are an error."""
    steps, i = np.unique(rows.column(row).to_numpy(), return_inverse=True)
    names, j = np.unique(rows.column(column).to_numpy(), return_inverse=True)
    place = i * len(names) + j
    if len(np.unique(place)) < len(place):
        raise ValueError(f"more than one value for a {row} and {column}")
    m = np.full(len(steps) * len(names), np.nan)
    m[place] = rows.column(value).to_numpy()
    return steps, names, m.reshape(len(steps), len(names))


def to_long(m: np.ndarray, rows: np.ndarray, columns: np.ndarray, heads: dict[str, pa.Scalar], kinds: dict[str, pa.DataType],
            row: str, column: str, value: str) -> pa.Table:
    """The matrix as rows in the order of ``kinds``, without NaN; ``heads`` are the same on every row."""
    i, j = np.nonzero(~np.isnan(m))
    made = {row: lambda t: pa.array(rows[i], t), column: lambda t: pa.array(columns[j], t), value: lambda t: pa.array(m[i, j], t)}
    return pa.table({c: made[c](t) if c in made else pa.repeat(heads[c], len(i)) for c, t in kinds.items()})


def aligned(m: np.ndarray, have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Rows of m, labelled by the sorted ``have``, at the labels ``want``; NaN where there is none."""
    out = np.full((len(want), m.shape[1]), np.nan)
    at = np.minimum(np.searchsorted(have, want), len(have) - 1)
    ok = have[at] == want
    out[ok] = m[at[ok]]
    return out

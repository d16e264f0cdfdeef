"""Arrow list arrays as flat numpy arrays, for functions that work on all lists of a batch at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Values that are made into text at a time.
STEP_VALUES = 1 << 20


def lengths(lists: pa.Array) -> np.ndarray:
    """Number of values of every list, 0 for a null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ends_of(n: np.ndarray) -> np.ndarray:
    """Where lists of ``n`` values begin in their flat values, and at last their end."""
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def values(lists: pa.Array) -> np.ndarray:
    """The values of all lists; as numpy has them, so nulls become NaN."""
    return lists.flatten().to_numpy(zero_copy_only=False)


def as_lists(n: np.ndarray, flat: pa.Array, null: np.ndarray | None = None) -> pa.Array:
    """Lists of ``n`` values each of ``flat``, null where ``null`` is set."""
    return pa.ListArray.from_arrays(pa.array(ends_of(n).astype(np.int32)), flat,
                                    mask=pa.array(null) if null is not None and null.any() else None)


def square(lists: pa.Array, width: int, fill) -> np.ndarray:
    """Lists as rows of ``width`` values, ended by ``fill``."""
    n, flat = lengths(lists), values(lists)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.full((len(n), width), fill, dtype=np.result_type(flat.dtype, type(fill)) if len(flat) else type(fill))
    at = np.arange(n.sum()) - np.repeat(ends_of(n)[:-1], n)
    out[np.repeat(np.arange(len(n)), n), at] = flat
    return out


def digests(lists: pa.Array) -> pa.Array:
    """md5 of the comma-joined values that aren't null, as hexadecimal text; null for a null."""
    child, n = lists.flatten(), lengths(lists)
    if child.null_count:
        n = np.bincount(np.repeat(np.arange(len(n)), n)[child.is_valid().to_numpy(zero_copy_only=False)], minlength=len(n))
        child = child.drop_null()
    out, ends = [], ends_of(n)
    for a, b in steps(n + 1, STEP_VALUES):
        joined = pc.binary_join(as_lists(n[a:b], child.slice(ends[a], ends[b] - ends[a]).cast(pa.string())), ",")
        out += [hashlib.md5(x.encode()).hexdigest() for x in joined.to_pylist()]
    return pc.if_else(lists.is_valid(), pa.array(out, pa.string()), pa.scalar(None, pa.string()))


def sums(lists: pa.Array, of: np.ndarray) -> pa.Array:
    """For every list the sum of what ``of`` has for its values; null for a null."""
    ends = ends_of(lengths(lists))
    return pa.array(np.diff(np.concatenate([[0], np.cumsum(of, dtype=np.int64)])[ends]),
                    mask=lists.is_null().to_numpy(zero_copy_only=False))


def steps(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` in the sum of their sizes, one row at least."""
    at = np.cumsum(sizes)
    cuts = np.unique([0, len(at), *(np.searchsorted(at, np.arange(most, at[-1], most)) if len(at) else [])]).astype(int)
    return zip(cuts.tolist(), cuts[1:].tolist())

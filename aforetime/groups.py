"""Whole groups from a sorted stream of batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd


def starts_of(frame: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Row positions at which a group begins; nulls equal each other."""
    new = np.zeros(len(frame), bool)
    if len(frame):
        new[0] = True
    for key in keys:
        values = frame[key].to_numpy()
        both_null = pd.isna(values[1:]) & pd.isna(values[:-1])
        new[1:] |= (values[1:] != values[:-1]) & ~both_null
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames that hold whole groups only, with the positions at which groups begin.

    The batches come sorted by `keys`; the last group of a batch waits for the
    next one.
    """
    open_rows: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if open_rows and len(starts_of(pd.concat([open_rows[-1].iloc[-1:], batch], ignore_index=True), keys)) == 1:
            open_rows.append(batch)  # a large group is put together once
            continue
        frame = pd.concat([*open_rows, batch], ignore_index=True) if open_rows else batch.reset_index(drop=True)
        starts = starts_of(frame, keys)
        if len(starts) > 1:
            yield frame.iloc[: starts[-1]], starts[:-1]
        open_rows = [frame.iloc[starts[-1] :]]
    if open_rows:
        frame = open_rows[0].reset_index(drop=True)
        yield frame, starts_of(frame, keys)

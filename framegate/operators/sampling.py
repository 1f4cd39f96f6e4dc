"""Greedy samplers: what is kept depends on what was kept before.

No window function expresses that. Each task gets its keys sorted and runs one small state a
key over the rows as they stream by, in batches: memory does not grow with a key.
ordered_runs hands on arrays of which rows are picked, ordered_fold columns, for rules that
answer each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from framegate.operators.windows import Names


def ordered_fold(df: DataFrame, key: Names, order: Names, new_state: Callable[[], Any], step: Callable[[Any, dict[str, list]], list[list]], schema: str) -> DataFrame:
    """step(state, columns) gets the rows of one key in a batch, in order, as lists of Python
    values by column; it may change the state and returns the output's columns."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            plain = {c: batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in batch.columns}
            parts = []
            for mine, low, high in _turns(batch, list(key)):
                if state is None or mine != current:
                    current, state = mine, new_state()
                parts.append(step(state, {c: v[low:high] for c, v in plain.items()}))
            yield pd.DataFrame({c: [v for part in parts for v in part[k]] for k, c in enumerate(names)}, columns=names)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def _turns(batch: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Key, first place and place after the last of each key's rows in a sorted batch."""
    if batch.empty:
        return
    named = batch[keys]
    turn = ((named != named.shift()) & ~(named.isna() & named.shift().isna())).any(axis=1).to_numpy(copy=True)
    turn[0] = True
    cuts = [*np.flatnonzero(turn), len(batch)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        yield tuple(None if pd.isna(v) else v for v in named.iloc[low]), low, high


def ordered_runs(df: DataFrame, key: Names, order: Names, new_state: Callable[[], dict], step: Callable[[dict, pd.DataFrame], np.ndarray], schema: str, dealt: bool = False) -> DataFrame:
    """step(state, rows of one key in a batch, in order) may change the state and returns
    the places of the rows that stay. Work goes by arrays, not by rows. dealt: the rows of
    each key are in one partition already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            kept = [np.zeros(0, int)]
            for mine, low, high in _turns(batch, list(key)):
                if state is None or mine != current:
                    current, state = mine, new_state()
                kept.append(low + step(state, batch.iloc[low:high]))
            yield batch.iloc[np.concatenate(kept)]

    rows = df if dealt else df.repartition(*key)
    return rows.sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def min_gap_sample(df: DataFrame, key: str, us: str, tie: str, gap_us: int) -> DataFrame:
    """key, us and tie of the rows at least gap_us after the last kept one (the first stays)."""

    def step(state: dict, rows: pd.DataFrame) -> np.ndarray:
        at, kept = rows[us].to_numpy(), []
        i = int(np.searchsorted(at, state["at"] + gap_us)) if state else 0
        while i < len(at):
            kept.append(i)
            i = max(i + 1, int(np.searchsorted(at, at[i] + gap_us)))  # one jump a kept row
        if kept:
            state["at"] = int(at[kept[-1]])
        return np.array(kept, int)

    return ordered_runs(df.select(key, us, tie), [key], [us, tie], dict, step, f"{key} long, {us} long, {tie} long")


def anchored_windows(df: DataFrame, key: Names, us: str, tie: str, every_us: int) -> DataFrame:
    """Rows on which a periodic report falls: the first at least every_us after the one before,
    counted from the key's first row, which reports nothing. df's columns stay."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def step(state: dict, rows: pd.DataFrame) -> np.ndarray:
        at, told = rows[us].to_numpy(), []
        anchor = state.get("at", int(at[0]))
        i = int(np.searchsorted(at, anchor + every_us))
        while i < len(at):
            told.append(i)
            anchor = int(at[i])
            i = int(np.searchsorted(at, anchor + every_us))  # one jump a report
        state["at"] = anchor
        return np.array(told, int)

    return ordered_runs(df, key, [us, tie], dict, step, schema, dealt=True)


def throttle_repeats(df: DataFrame, key: str, us: str, tie: str, text: str, any_us: int, same_us: int) -> DataFrame:
    """Messages that are spoken: none within any_us of the last one, nor the same text
    within same_us of it."""

    def step(state: dict, rows: pd.DataFrame) -> np.ndarray:
        at, said, kept = rows[us].to_numpy(), rows[text].to_numpy(object), []
        last, word = state.get("at"), state.get("text")
        i = 0
        while i < len(at):
            if last is not None and at[i] - last < any_us:
                i = int(np.searchsorted(at, last + any_us))  # nothing is said before
            elif last is not None and said[i] == word and at[i] - last < same_us:
                i += 1
            else:
                kept.append(i)
                last, word = int(at[i]), said[i]
                i += 1
        state.update(at=last, text=word)
        return np.array(kept, int)

    return ordered_runs(df.select(key, us, tie, text), [key], [us, tie], dict, step, f"{key} long, {us} long, {tie} long, {text} string")

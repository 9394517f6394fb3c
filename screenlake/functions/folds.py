"""Folds over sorted groups, for steps that depend on the one before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold_sorted(df: DataFrame, key: str, order: list[str], schema: str, fold: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """``fold`` on the rows of each key in order; ``key`` is the first column. One shuffle; many small groups share a batch, and only one group is held."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    out += fold(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(fold(held), columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def scan_sorted(df: DataFrame, key: str, order: list[str], schema: str, step: Callable[[dict, tuple], list[tuple]], end: Callable[[dict], list[tuple]]) -> DataFrame:
    """``step`` on each row of each key in order, with a state that starts empty, and ``end`` on the last state; ``key`` is the first column.

    Rows stream through, so a key of any length holds no more than its state.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        now: object = None
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False, name=None):
                if row[0] != now:
                    out += end(state) if state else []
                    state, now = {}, row[0]
                out += step(state, row)
            yield pd.DataFrame(out, columns=names)
        if state:
            yield pd.DataFrame(end(state), columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)

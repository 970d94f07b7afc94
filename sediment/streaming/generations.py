"""The flush fold over a stream of ops: each shard's waiting keys are its state, kept by the state store.

A batch's ops of a shard are folded in the order of their sequence after those of earlier batches, so the stream must
bring a shard's ops in order from batch to batch. The state is one run's keys: at most the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators import state as ops
from ..shipping import ship

OUT = "shard string, seq long, generation long, closes boolean"
STATE = "generation long, puts array<string>, gone array<string>"


def numbered(log: DataFrame, threshold: int, shard: str) -> DataFrame:
    """OUT: each op's generation, and whether its flush closes it. Append mode."""

    ship(log.sparkSession)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        generation, puts, gone = held.get if held.exists else (0, [], [])
        puts, gone = set(puts), set(gone)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        generations, closes = [], []
        for k, op in zip(rows["key"], rows["op"], strict=True):
            generations.append(generation)
            if op == ops.PUT:
                puts.add(k)
                gone.discard(k)
                full = len(puts) >= threshold
            else:
                puts.discard(k)
                gone.add(k)
                full = len(puts) + len(gone) >= threshold
            closes.append(full)
            if full:
                generation, puts, gone = generation + 1, set(), set()
        held.update((generation, sorted(puts), sorted(gone)))
        yield pd.DataFrame({"shard": key[0], "seq": rows["seq"].to_numpy(), "generation": generations, "closes": closes})

    slim = log.selectExpr(f"cast({shard} as string) as shard", "cast(seq as long) as seq", "key", "cast(op as int) as op")
    return slim.groupBy("shard").applyInPandasWithState(fold, OUT, STATE, "append", "NoTimeout")

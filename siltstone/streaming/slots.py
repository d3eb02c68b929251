"""Requests admitted one at a time for each host: not before they come, not closer than the host's delay, no more than its budget.

``admitted`` replays a batch: with a host's n-th request at a_n and its delay d,
the slot of the n-th is the greatest of a_k + (n - k) d over k up to n, a running
maximum.  ``stream`` does the same over micro-batches: a host's last slot
and how many it had are keyed state, two numbers that stay (a timeout would keep
a run that drains its source from ending).  Requests without a host or a time are not admitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ADMITTED = "host string, id long, at timestamp, slot timestamp"


def admitted(requests: DataFrame, *, budget: int | None = None) -> DataFrame:
    """``requests`` (host, id, at, delay in milliseconds) with slot, the time at which each may be sent; those over budget are left out.

    A host's requests come in the order of at, then id; its delay is that of all of them.
    """
    order = W.partitionBy("host").orderBy("at", "id")
    ms = F.unix_millis(F.col("at").cast("timestamp"))
    rows = requests.where("host IS NOT NULL AND at IS NOT NULL").withColumn("_n", F.row_number().over(order))
    if budget is not None:
        rows = rows.where(F.col("_n") <= budget)
    reach = F.max(ms - F.col("_n") * F.col("delay")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("slot", F.timestamp_millis(reach + F.col("_n") * F.col("delay"))).drop("_n")


def stream(requests: DataFrame, *, budget: int | None = None) -> DataFrame:
    """``admitted`` for a stream of requests: a later micro-batch comes after an earlier one."""

    def fn(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # a micro-batch's requests of one host, a delay apart each: bounded by what the trigger reads
        batch = pd.concat(list(rows)).sort_values(["at", "id"])
        last, used = state.get if state.exists else (None, 0)
        slots = []
        for at, delay in zip(batch["at"], batch["delay"]):
            if budget is not None and used >= budget:
                break
            ms = at.value // 1_000_000
            last = ms if last is None else max(ms, last + int(delay))
            used += 1
            slots.append(pd.Timestamp(last, unit="ms"))
        if used:
            state.update((last, used))
        out = batch.head(len(slots))[["host", "id", "at"]].copy()
        out["slot"] = slots
        yield out

    keyed = requests.where("host IS NOT NULL AND at IS NOT NULL").groupBy("host")
    return keyed.applyInPandasWithState(fn, ADMITTED, "last long, used long", "append", GroupStateTimeout.NoTimeout)

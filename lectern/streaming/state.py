"""Streams: deduplication with a time limit, incremental ingest, bounded keyed memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fresh(stream: DataFrame, keys: list[str], ts: str, ttl: str) -> DataFrame:
    """Rows whose keys were not seen within ttl."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, key: str, size: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """(window, key, n) per tumbling window; rows later than ``late`` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each batch of new files to upsert once."""
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MEMORY = "key long, id string, weight int, body string"


def memory(stream: DataFrame, cap: int = 100) -> DataFrame:
    """(key, id, weight, body): the entries of each key after its ops (key, seq, op, id, weight, body).

    add puts an entry, remove drops it, set changes its body, bump adds to its weight; beyond cap
    the lightest, then the first added, are evicted. Ops apply in the order of seq.
    """

    def apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries = dict(zip(*[state.get[0], zip(state.get[1], state.get[2])])) if state.exists else {}
        ops = pd.concat(list(batches)).sort_values("seq")
        for op, name, weight, body in zip(ops.op, ops.id, ops.weight, ops.body):
            old = entries.get(name)
            if op == "add":
                entries[name] = (int(weight), body)
            elif op == "remove":
                entries.pop(name, None)
            elif op == "set" and old:
                entries[name] = (old[0], body)
            elif op == "bump" and old:
                entries[name] = (old[0] + int(weight), old[1])
            while len(entries) > cap:
                del entries[min(entries, key=lambda n: entries[n][0])]
        state.update((list(entries), [w for w, _ in entries.values()], [b for _, b in entries.values()]))
        yield pd.DataFrame({"key": key[0], "id": list(entries), "weight": [w for w, _ in entries.values()], "body": [b for _, b in entries.values()]})

    return stream.groupBy("key").applyInPandasWithState(apply, MEMORY, "ids array<string>, weights array<int>, bodies array<string>", "update", GroupStateTimeout.NoTimeout)

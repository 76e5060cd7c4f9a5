"""Leases on keys: one owner works on a key at a time; an expired lease may be taken over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldwright.streaming.common import drain, file_stream

#: Seconds that a lease holds, and that callers stay away after a failure.
TTL, COOLDOWN = 600, 60
OUTPUT = "key long, id long, op string, ok boolean, status string"
DETAIL = OUTPUT + ", limited_until long"
_STATE = "status string, owner string, expires long"


def requests_of(events: DataFrame) -> DataFrame:
    """Events (event_id, user_id, ts, event_type) as requests (key, id, micros, owner, op): purchases complete, errors fail, the rest acquire."""
    op = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("acquire")
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), (F.col("event_id") % 3).cast("string").alias("owner"), op.alias("op"))


def step(state: tuple[str, str, int] | None, micros: int, owner: str, op: str, ttl: int = TTL) -> tuple[tuple[str, str, int] | None, bool, str]:
    """The state after a request, whether it was granted, and the status to report. Only the owner of a running lease ends it.

    The last part of a state is when it expires; of a failed one, until when callers stay away.
    """
    if op == "acquire":
        if state is None or (state[0] == "in_flight" and state[2] < micros):
            return ("in_flight", owner, micros + max(ttl, 1) * 1_000_000), True, "in_flight"
        return state, False, state[0]
    if state is not None and state[0] == "in_flight" and state[1] == owner:
        status = "done" if op == "complete" else "failed"
        return (status, owner, micros + COOLDOWN * 1_000_000 if status == "failed" else state[2]), True, status
    return state, False, "none" if state is None else state[0]


def fold_batch(requests: DataFrame) -> DataFrame:
    """All requests in order of time, each key folded as a stream of its sorted rows, so a hot key needs no memory for them."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for rows in batches:
            said = []
            for k, micros, owner, op in zip(rows["key"], rows["micros"], rows["owner"], rows["op"]):
                state = state if k == key else None
                key = k
                state, ok, status = step(state, micros, owner, op)
                said.append((ok, status, state[2] if state is not None and state[0] == "failed" else None))
            yield rows[["key", "id", "op"]].assign(ok=[x[0] for x in said], status=[x[1] for x in said], limited_until=pd.array([x[2] for x in said], dtype="Int64"))

    return requests.repartition("key").sortWithinPartitions("key", "micros", "id").mapInPandas(fold, DETAIL)


def single_flight(requests: DataFrame, ttl: int = 30, most_wait: int = 8) -> DataFrame:
    """Requests (key, id, micros, took, good) for a provider's answer, each with outcome, waited (micros) and error.

    The first request of a key calls the provider for ``took`` micros; its answer serves all later ones from then on, a
    failure turns them away. Requests meanwhile wait, up to ``most_wait`` seconds. A call longer than ``ttl`` seconds loses its
    lease, and the next request calls again. Each key is folded as a stream of its sorted rows.
    """
    ttl, most_wait = ttl * 1_000_000, most_wait * 1_000_000

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ends, good, expires = None, None, False, 0
        for rows in batches:
            said = []
            for k, t, took, fine in zip(rows["key"], rows["micros"], rows["took"], rows["good"]):
                if k != key:
                    key, ends = k, None
                if ends is None or (expires < t < ends):
                    ends, good, expires = t + took, fine, t + ttl
                    said.append(("provider_winner", None, None) if fine else ("unavailable", None, "rate_limited"))
                elif ends <= t:
                    said.append(("cache_hit", None, None) if good else ("unavailable", None, "rate_limited"))
                elif ends <= min(t + most_wait, expires):
                    said.append(("waited_cache_hit", ends - t, None) if good else ("unavailable", ends - t, "rate_limited"))
                elif expires < t + most_wait:
                    said.append(("unavailable", expires - t, "lease_expired"))
                else:
                    said.append(("unavailable", most_wait, "lease_wait_timeout"))
            yield rows[["key", "id"]].assign(outcome=[x[0] for x in said], waited=pd.array([x[1] for x in said], dtype="Int64"), error=[x[2] for x in said])

    return requests.repartition("key").sortWithinPartitions("key", "micros", "id").mapInPandas(fold, "key long, id long, outcome string, waited long, error string")


def fold_stream(requests: DataFrame) -> DataFrame:
    """The same over a stream. Requests of a batch are taken in order of time; a request of an older batch is not undone by a later, earlier-dated one."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else None
        rows = pd.concat(list(frames)).sort_values(["micros", "id"])
        said = []
        for micros, owner, op in zip(rows["micros"], rows["owner"], rows["op"]):
            state, ok, status = step(state, micros, owner, op)
            said.append((ok, status))
        if state is not None:
            held.update(state)
        yield rows[["key", "id", "op"]].assign(ok=[ok for ok, _ in said], status=[s for _, s in said])

    return requests.groupBy("key").applyInPandasWithState(fold, OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_stream(spark: SparkSession, path: str) -> DataFrame:
    return drain(fold_stream(requests_of(file_stream(spark, path))), "leases", "append")

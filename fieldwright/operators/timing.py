"""Time windows, limits, state machines, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed steps of an order.
TRANSITIONS = (
    ("queued", "assigned"), ("queued", "cancelled"), ("assigned", "in_review"), ("assigned", "queued"), ("assigned", "cancelled"),
    ("in_review", "needs_user_clarification"), ("in_review", "approved_for_render"), ("in_review", "cancelled"),
    ("needs_user_clarification", "in_review"), ("needs_user_clarification", "cancelled"),
    ("approved_for_render", "artifact_generated"), ("approved_for_render", "in_review"), ("artifact_generated", "delivery_pending"),
    ("delivery_pending", "delivered"), ("delivery_pending", "delivery_failed"), ("delivery_failed", "delivery_pending"), ("delivery_failed", "cancelled"),
)
#: List prices of a call in millionths of a dollar.
PRICES = {"google_vision": 1500, "google_docai": 1500, "gemini": 2000, "deepseek_chat": 4000, "deepseek_reasoner": 8000}


def rolling_counts(events: DataFrame, key: str, seconds: int, threshold: float) -> DataFrame:
    """Events with the number of the key's events in the last ``seconds``, both ends included, and alert if above the threshold."""
    window = Window.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    rows = events.withColumn("n", F.count(F.lit(1)).over(window))
    return rows.withColumn("alert", (F.col("n") > threshold) if threshold == threshold and abs(threshold) != float("inf") else F.lit(False))


def fixed_window_limit(requests: DataFrame, most: int, seconds: int) -> DataFrame:
    """Requests (key, ts, id) with their place in a window that the first request opens; the next one after its end opens a new one.

    Allowed up to ``most`` in a window. Sorted rows of a task's keys are folded as a stream, so a key needs no memory for its rows.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, count = None, 0, 0
        for rows in batches:
            places = []
            for k, t in zip(rows["key"], rows["micros"]):
                if k != key or t - start > seconds * 1_000_000:
                    key, start, count = k, t, 0
                count += 1
                places.append(count)
            yield pd.DataFrame({"key": rows["key"], "id": rows["id"], "place": places})

    rows = requests.select("key", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    placed = rows.repartition("key").sortWithinPartitions("key", "micros", "id").mapInPandas(fold, "key long, id long, place long")
    return placed.withColumn("allowed", F.col("place") <= most).withColumn("remaining", F.greatest(F.lit(0), F.lit(most) - F.col("place")))


def escalation_stage(age_hours: Column, last: Column) -> Column:
    """The next alert of a ticket: third_channel from 12 hours, second_alert from 4, and only if it goes beyond the last one."""
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, ("created", "second_alert", "third_channel"))), c), F.lit(0))
    due = F.when(age_hours >= 12, "third_channel").when(age_hours >= 4, "second_alert")
    return F.when(rank(due) > rank(last), due)


def sla_colour(age_hours: Column) -> Column:
    return F.when(age_hours < 4, "green").when(age_hours <= 12, "amber").otherwise("red")


def transition_audit(steps: DataFrame, key: str) -> DataFrame:
    """Steps (key, ordinal, status) with the status before and whether the step is allowed; a first step must be to queued."""
    order = Window.partitionBy(key).orderBy("ordinal")
    rows = steps.withColumn("from_status", F.lag("status").over(order)).withColumn("version", F.row_number().over(order).cast("long"))
    allowed = F.concat("from_status", F.lit(">"), "status").isin([f"{a}>{b}" for a, b in TRANSITIONS])
    return rows.withColumn("valid", F.coalesce(allowed, F.col("status") == "queued"))


def claim_order(items: DataFrame, queue: str, grain: str = "hour") -> DataFrame:
    """Due items of each queue in the order in which workers would claim them: by due time, then age. Locks are the store's matter.

    Items are ordered within a slot of due time, and slots are counted before, so one queue with most of the items is
    spread over as many tasks as it has slots.
    """
    slot = F.date_trunc(grain, "due_at")
    slots = items.groupBy(F.col(queue).alias("_queue"), slot.alias("_slot")).agg(F.count(F.lit(1)).alias("n"))
    before = (F.sum("n").over(Window.partitionBy("_queue").orderBy(F.col("_slot").asc_nulls_first())) - F.col("n")).alias("_before")
    inside = Window.partitionBy(queue, slot).orderBy(F.col("due_at").asc_nulls_first(), "created_at", "id")
    rows = items.withColumn("_at", F.row_number().over(inside))
    out = rows.join(slots.select("_queue", "_slot", before), F.col(queue).eqNullSafe(F.col("_queue")) & slot.eqNullSafe(F.col("_slot")))
    return out.select(*items.columns, (F.col("_before") + F.col("_at")).alias("claim_no"))


def call_cost(provider: Column, model: Column) -> Column:
    """List price of a call in millionths of a dollar; unknown providers cost 0."""
    deep = F.when(F.coalesce(F.lower(model), F.lit("")).contains("reason"), PRICES["deepseek_reasoner"]).otherwise(PRICES["deepseek_chat"])
    known = F.coalesce(*[F.when(provider == p, F.lit(c)) for p, c in PRICES.items()], F.lit(0))
    return F.when(provider == "deepseek", deep).otherwise(known).cast("long")


def daily_spend(calls: DataFrame, cap: int, grain: str = "minute") -> DataFrame:
    """Calls with the provider's running cost of the day, in order; within: it is at most the cap.

    Calls are summed in order within a slot of time, and slots are summed before, so a provider's day is spread over as many
    tasks as it has slots.
    """
    day, slot = F.to_date("at"), F.date_trunc(grain, "at")
    slots = calls.groupBy(F.col("provider").alias("_provider"), day.alias("_day"), slot.alias("_slot")).agg(F.sum("cost").alias("_cost"))
    before = (F.sum("_cost").over(Window.partitionBy("_provider", "_day").orderBy(F.col("_slot").asc_nulls_first())) - F.col("_cost")).alias("_before")
    inside = Window.partitionBy("provider", slot).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = calls.withColumn("_own", F.sum("cost").over(inside))
    out = rows.join(slots.select("_provider", "_slot", before), F.col("provider").eqNullSafe(F.col("_provider")) & slot.eqNullSafe(F.col("_slot")))
    spent = F.col("_before") + F.col("_own")
    return out.select(*calls.columns, spent.alias("spent"), (spent <= cap).alias("within"))


def coordination(calls: DataFrame, key: str) -> DataFrame:
    """(key): counts and costs of calls by outcome."""
    of = lambda *names: F.col("outcome").isin(*names)
    return calls.groupBy(key).agg(
        F.count(F.lit(1)).alias("requested_calls"), F.count_if(of("cache_hit", "waited_cache_hit")).alias("cache_hits"), F.count_if(of("waited_cache_hit")).alias("dedup_collapses"),
        F.count_if(of("provider_winner")).alias("provider_calls"), F.coalesce(F.sum(F.when(of("cache_hit", "waited_cache_hit"), F.col("cost"))), F.lit(0)).alias("avoided_cost"),
        F.coalesce(F.sum(F.when(of("provider_winner"), F.col("cost"))), F.lit(0)).alias("actual_cost"),
    )


def budget_reason(enabled: Column, planned: Column, cost: Column, today: Column, month: Column, run_docs: float, run_cost: float, day: float, month_cap: float) -> Column:
    """Why a run of paid calls is denied, or ok: paid calls must be on, all amounts finite and not negative, and every cap kept, in this order."""
    off = ~F.coalesce(enabled, F.lit(False))
    unusable = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")) | (c < 0)
    bad = unusable(planned) | unusable(cost) | unusable(today) | unusable(month)
    return (
        F.when(off, "paid_calls_disabled").when(bad, "invalid_request").when(planned > run_docs, "per_run_doc_cap_exceeded").when(cost > run_cost, "per_run_cost_cap_exceeded")
        .when(today + cost > day, "daily_cap_exceeded").when(month + cost > month_cap, "monthly_cap_exceeded").otherwise("ok")
    )


#: Older names of ticket statuses, and the steps that are allowed between statuses.
TICKET_ALIASES = {"pending": "queued", "cancelled": "rejected"}
TICKET_STEPS = {
    "queued": ("assigned", "in_review", "rejected"), "assigned": ("in_review", "rejected"), "in_review": ("needs_user_clarification", "operator_completed", "rejected"), "needs_user_clarification": ("in_review", "rejected"),
    "operator_completed": ("approved_for_render", "rejected"), "approved_for_render": ("completed",),
}


def ticket_audit(steps: DataFrame, key: str) -> DataFrame:
    """Steps (key, ordinal, status) of tickets with valid: the step is allowed whatever names the statuses go by; a first one must be to queued."""
    canonical = F.coalesce(*[F.when(F.col("status") == a, F.lit(s)) for a, s in TICKET_ALIASES.items()], F.col("status"))
    rows = steps.withColumn("canonical", canonical).withColumn("before", F.lag("canonical").over(Window.partitionBy(key).orderBy("ordinal")))
    allowed = F.concat("before", F.lit(">"), "canonical").isin([f"{a}>{b}" for a, steps in TICKET_STEPS.items() for b in steps])
    return rows.withColumn("valid", F.coalesce(allowed, F.col("canonical") == "queued")).drop("before")


def optimistic_appends(requests: DataFrame) -> DataFrame:
    """Requests (key, ordinal, expected) to append a version: each with stored_version if it was stored, else null, a conflict.

    A request is stored if it expects the version that is the newest at its turn. In order, the n-th version is stored by
    the first request after that of version n - 1 that expects n - 1; a fold over sorted rows, so a key needs no memory for its rows.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, newest = None, 0
        for rows in batches:
            stored = []
            for k, expected in zip(rows["key"], rows["expected"]):
                if k != key:
                    key, newest = k, 0
                fits = expected == newest
                newest += fits
                stored.append(newest if fits else None)
            yield rows.assign(stored_version=pd.array(stored, dtype="Int64"))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema) + ", stored_version long"
    return requests.repartition("key").sortWithinPartitions("key", "ordinal").mapInPandas(fold, schema)


def draft_expired(saved: Column, now: Column, seconds: int) -> Column:
    """Whether a draft is older than its life; one without a valid time is not."""
    at = F.try_to_timestamp(saved)
    return F.coalesce(F.unix_micros(now) - F.unix_micros(at) > seconds * 1_000_000, F.lit(False))

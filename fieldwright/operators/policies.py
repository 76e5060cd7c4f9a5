"""Row policies: a table of policies made predicates and semi-joins.

A policy lets a principal do an action on rows of a table; several policies for one action are alternatives, and where none applies nothing is
allowed. What a policy asks of other rows (a parent that is one's own) is a join with the distinct keys of those parents, so no row is asked one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("select", "insert", "update", "delete")
#: Keys of parents that one task holds, on average; the number of tasks follows from it. So few as the second number are sent to all tasks.
KEYS, FEW = 500_000, 10_000


@dataclass(frozen=True)
class Policy:
    """kind: own (``column`` is the principal), free (``column`` is null), published (``column`` is true), anyone, known (there is a principal), moderator (or
    admin), admin, or parent (``column`` is the ``key`` of a row of ``parent`` that the ``parents`` policies let through). action ``all`` stands for every action."""

    table: str
    action: str
    kind: str
    column: str | None = None
    parent: str | None = None
    key: str = "id"
    parents: tuple[Policy, ...] = ()


def _own(table: str, action: str, column: str, *more: str) -> tuple[Policy, ...]:
    return Policy(table, action, "own", column), *[Policy(table, action, kind, column) for kind in more]


def _via(table: str, action: str, column: str, parent: str, *kinds: str) -> Policy:
    return Policy(table, action, "parent", column, parent, "id", tuple(Policy(parent, action, kind, "user_id") for kind in kinds))


#: Who may do what.
POLICIES = (
    *_own("profiles", "select", "id", "moderator"), *_own("profiles", "update", "id"), *_own("profiles", "insert", "id"),
    *_own("user_sessions", "select", "user_id", "moderator"), *_own("user_sessions", "insert", "user_id", "free"),
    *_own("translations_orders", "select", "user_id", "moderator"), *_own("translations_orders", "insert", "user_id"), *_own("translations_orders", "update", "user_id", "moderator"),
    _via("translation_files", "select", "order_id", "translations_orders", "own", "moderator"), _via("translation_files", "insert", "order_id", "translations_orders", "own"),
    *_own("form_sessions", "select", "user_id", "moderator"), *_own("form_sessions", "insert", "user_id", "free"), *_own("form_sessions", "update", "user_id"),
    _via("form_answers", "select", "session_id", "form_sessions", "own", "moderator"), _via("form_answers", "insert", "session_id", "form_sessions", "own", "free"),
    Policy("official_sources", "select", "anyone"), Policy("official_sources", "all", "admin"),
    Policy("canonical_answers", "select", "published", "is_published"), Policy("canonical_answers", "select", "moderator"), Policy("canonical_answers", "all", "moderator"),
    *_own("risk_flags", "select", "user_id", "moderator"), *_own("risk_flags", "insert", "user_id", "moderator"),
    Policy("moderation_queue", "all", "moderator"), *_own("bot_threads", "select", "user_id", "moderator"), Policy("scanner_hits", "all", "admin"), Policy("facebook_leads", "all", "moderator"),
    Policy("audit_log", "insert", "known"), Policy("audit_log", "select", "admin"),
)


@dataclass(frozen=True)
class Principal:
    """Who asks; without an id nobody is signed in. The service is past all policies."""

    id: object = None
    role: str | None = None
    service: bool = False


def principal(id_: object, roles: DataFrame) -> Principal:
    """The principal of an id with their role: the first of admin, moderator, none. roles: (id, role)."""
    found = {r.role for r in roles.where(F.col("id") == F.lit(id_)).where(F.col("role").isin("admin", "moderator")).select("role").distinct().collect()} if id_ is not None else set()
    return Principal(id_, "admin" if "admin" in found else "moderator" if "moderator" in found else None)


def _simple(policy: Policy, who: Principal) -> Column | bool:
    """A policy that asks no other table, as a predicate, or told at once."""
    if policy.kind == "anyone":
        return True
    if policy.kind == "known":
        return who.id is not None
    if policy.kind in ("moderator", "admin"):
        return who.role == "admin" or (policy.kind == "moderator" and who.role == "moderator")
    c = F.col(policy.column)
    if policy.kind == "published":
        return F.coalesce(c, F.lit(False))
    if policy.kind == "free":
        return c.isNull()
    if policy.kind == "own":
        return False if who.id is None else F.coalesce(c == F.lit(who.id), F.lit(False))
    raise ValueError(f"unknown kind of policy: {policy.kind}")


def _dealt(keys: DataFrame) -> DataFrame:
    """The distinct keys, dealt over as many tasks as they need; a task holds its own as a hash table, and the rows that ask for them pass by unsorted. A few keys are broadcast."""
    n = keys.count()
    if n <= FEW:
        return F.broadcast(keys.distinct())
    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // KEYS))
    return keys.repartition(parts, *keys.columns).distinct().hint("shuffle_hash")


def allowed(rows: DataFrame, table: str, action: str, who: Principal, tables: dict[str, DataFrame], policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The rows of ``table`` on which the principal may do the action; for insert and update, rows as they would be stored.

    tables: those that parents are looked for in. An action or table without a policy lets nothing through; unknown actions raise ValueError.
    """
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    if who.service:
        return rows
    own = [p for p in policies if p.table == table and p.action in (action, "all")]
    told = [_simple(p, who) for p in own if p.kind != "parent"]
    if any(t is True for t in told):
        return rows
    asked = [p for p in own if p.kind == "parent"]
    flags = []
    out = rows
    for n, p in enumerate(asked):
        parents = allowed(tables[p.parent], p.parent, action, who, tables, tuple(Policy(p.parent, action, q.kind, q.column, q.parent, q.key, q.parents) for q in p.parents))
        keys = _dealt(parents.select(F.col(p.key).alias(f"_parent{n}")).where(F.col(f"_parent{n}").isNotNull()))
        out = out.join(keys, F.col(p.column) == F.col(f"_parent{n}"), "left")
        flags.append(F.col(f"_parent{n}").isNotNull())
    conditions = [t for t in told if t is not False] + flags
    if not conditions:
        return rows.where(F.lit(False))
    return out.where(reduce(lambda a, b: a | b, conditions)).select(*rows.columns)

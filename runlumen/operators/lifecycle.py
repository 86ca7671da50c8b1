"""Reconciliation: discovery, leases, claims, failures, replay bounds and the lifecycle fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlumen.schemas import (
    FALLBACK_CODE,
    INTERRUPTED_CODE,
    LEASE_MINUTES,
    LOOKBACK_HOURS,
    MAX_ATTEMPTS,
    MAX_PAGES,
    MAX_PARENTS,
    MAX_REPLAYS,
    MAX_TASK_IDS,
    SAFE_COLLECTION_CODES,
)

#: Task ids numbered together in a replay plan.
REPLAY_BLOCK = 1 << 16
LEASE = f"INTERVAL '{LEASE_MINUTES}' MINUTE"


# ---- discovery -------------------------------------------------------------------------------

def lookback(pages: DataFrame, as_of: Column) -> DataFrame:
    """Pages of parents that started within the last 24 hours before the clock."""
    start = F.col("start_time")
    window = F.expr(f"INTERVAL '{LOOKBACK_HOURS}' HOUR")
    return pages.filter((start >= as_of - window) & (start <= as_of))


def task_ids(pages: DataFrame) -> DataFrame:
    """Distinct task ids of a parent: live tasks and repair history; other keys are dropped."""
    live = pages.select(
        "job_id", F.col("run_id").alias("parent_run_id"),
        F.explode(F.transform("tasks", lambda t: t["run_id"])).alias("task_run_id"))
    repairs = pages.select(
        "job_id", F.col("run_id").alias("parent_run_id"),
        F.explode("repair_task_run_ids").alias("task_run_id"))
    both = live.unionByName(repairs).filter(F.col("task_run_id") > 0)
    return both.distinct()


def discovery_guard(pages: DataFrame, most_parents: int = MAX_PARENTS, most_pages: int = MAX_PAGES,
                    most_tasks: int = MAX_TASK_IDS) -> DataFrame:
    """Per job: parents, pages and task ids seen; a bound that is passed is an error, never a cut."""
    ids = task_ids(pages).groupBy("job_id").agg(F.count("*").alias("task_ids"))
    per_parent = pages.groupBy("job_id", "run_id").agg(
        F.count_distinct("page_no").alias("pages"))
    counts = per_parent.groupBy("job_id").agg(
        F.count("*").alias("parents"), F.max("pages").alias("most_pages"))
    error = (
        F.when(F.col("parents") > most_parents, "RECONCILIATION_PARENT_LIMIT_EXCEEDED")
        .when(F.col("most_pages") > most_pages, "RECONCILIATION_PARENT_PAGINATION_INVALID")
        .when(F.col("task_ids") > most_tasks, "RECONCILIATION_TASK_LIMIT_EXCEEDED")
    )
    return counts.join(ids, "job_id", "left").fillna(0, ["task_ids"]).withColumn(
        "error_code", error)


def page_chains(pages: DataFrame, parent: list[str], most: int = MAX_PAGES) -> DataFrame:
    """Per parent: pages, pages in the chain of tokens from the first one, and an error or null.

    ``pages`` has token (null for the first page) and next_token (null for the last). The chain is
    followed for all parents at once by doubling: after round k a page points 2^k pages on. It is an
    error if a token comes twice, a chain does not end within ``most`` pages (so every loop is one), a
    page is not in the chain, a token is empty, or there is no first page.
    """
    first = F.coalesce("token", F.lit(""))
    bad = (F.col("token") == "") | (F.col("next_token") == "")
    nodes = pages.select(*parent, first.alias("at"), F.col("next_token").alias("to"), F.coalesce(bad, F.lit(False)).alias("bad"))
    facts = nodes.groupBy(*parent, "at").agg(F.count("*").alias("n"), F.min("to").alias("to"), F.bool_or("bad").alias("bad"))
    hops = facts.select(*parent, "at", "to", F.lit(1).alias("length"))
    for _ in range(max(1, (most - 1).bit_length())):
        ahead = hops.select(*parent, F.col("at").alias("to"), F.col("to").alias("further"), F.col("length").alias("more"))
        hops = hops.join(ahead, [*parent, "to"], "left").select(
            *parent, "at", F.when(F.col("more").isNotNull(), F.col("further")).otherwise(F.col("to")).alias("to"),
            (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"))
    start = hops.filter("at = ''").select(*parent, "to", "length")
    counts = facts.groupBy(*parent).agg(F.sum("n").alias("pages"), F.max("n").alias("copies"), F.bool_or("bad").alias("bad"))
    whole = F.col("to").isNull() & (F.col("length") == F.col("pages")) & (F.col("length") <= most)
    wrong = F.col("bad") | (F.col("copies") > 1) | ~F.coalesce(whole, F.lit(False))
    return counts.join(start, parent, "left").select(
        *parent, "pages", F.when(F.col("to").isNull(), F.col("length")).cast("bigint").alias("chain"),
        F.when(wrong, "RECONCILIATION_PARENT_PAGINATION_INVALID").alias("error_code"))


def attempt_contexts(ids: DataFrame, contexts: DataFrame, task_key: str) -> DataFrame:
    """Contexts of discovered tasks with the configured key, each with its verdict.

    The context must name the parent it was found under, and a task id may carry one context only.
    """
    wanted = contexts.filter(F.col("observed_task_key") == task_key)
    joined = ids.join(wanted, F.col("task_run_id") == F.col("dbt_task_run_id"))
    agrees = (F.col("observed_job_run_id") == F.col("parent_run_id")) & (
        F.col("observed_job_id") == F.col("job_id"))
    context = F.xxhash64("workspace_id", "observed_job_id", "observed_job_run_id", "repair_count",
                         "execution_count")
    per_task = joined.groupBy("dbt_task_run_id").agg(
        F.bool_and(agrees).alias("agrees"),
        (F.min(context) == F.max(context)).alias("single"),
        F.min("observed_job_id").alias("observed_job_id"),
        F.min("observed_job_run_id").alias("observed_job_run_id"),
        F.min("repair_count").alias("repair_count"),
    )
    error = F.when(~(F.col("agrees") & F.col("single")), "RECONCILIATION_TASK_CONTEXT_INVALID")
    return per_task.withColumn("error_code", error).drop("agrees", "single")


def missing(contexts: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Discovered attempts without a published root."""
    return contexts.join(published.select(*keys), keys, "left_anti")


# ---- transitions: one set-based statement each -----------------------------------------------

def _set(df: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(when, F.lit(False))
    return df.select(*(
        F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in df.columns))


def spent() -> Column:
    return F.col("collection_attempt_count") >= MAX_ATTEMPTS


def lease_state(clock: Column) -> Column:
    """HELD, EXPIRED or INVALID for a claimed attempt; null for every other state."""
    last = F.col("last_attempted_at")
    return F.when(F.col("collector_state") == "COLLECTING", (
        F.when(last.isNull() | (last > clock), "INVALID")
        .when(clock < last + F.expr(LEASE), "HELD").otherwise("EXPIRED")))


def expire_leases(roots: DataFrame, clock: Column) -> DataFrame:
    """Claims older than the lease become retryable, or terminal when no attempt is left."""
    state = F.when(F.col("normalized_digest").isNull() & spent(), "TERMINAL_FAILURE").otherwise(
        "RETRYABLE")
    return _set(roots, lease_state(clock) == "EXPIRED", {
        "collector_state": state, "collection_issue_code": F.lit(INTERRUPTED_CODE)})


def stamp(roots: DataFrame, run_id: Column) -> DataFrame:
    """Every unpublished attempt seen carries the reconciliation run that saw it."""
    return _set(roots, F.col("collector_state") != "PUBLISHED",
                {"last_reconciliation_run_id": run_id})


def claimable() -> Column:
    return F.col("collector_state").isin("DISCOVERED", "RETRYABLE") & (
        F.col("normalized_digest").isNotNull() | ~spent())


def claim(roots: DataFrame, clock: Column, chosen: Column | None = None) -> DataFrame:
    """Claim attempts; a root that already has a digest resumes without spending an attempt."""
    n = F.col("collection_attempt_count")
    when = claimable() if chosen is None else claimable() & chosen
    return _set(roots, when, {
        "collector_state": F.lit("COLLECTING"),
        "last_attempted_at": clock,
        "collection_attempt_count": F.when(F.col("normalized_digest").isNull(), n + 1).otherwise(n),
        "collection_issue_code": F.lit(None).cast("string"),
    })


def safe_code(code: Column) -> Column:
    """Stored issue text comes from the closed list; anything else becomes one fixed code."""
    return F.when(code.isin(SAFE_COLLECTION_CODES), code).otherwise(FALLBACK_CODE)


def record_failures(roots: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """Apply failures (keys, raw_issue) to claimed attempts."""
    raw = failures.select(*keys, F.col("raw_issue"), F.lit(True).alias("failed"))
    joined = roots.join(raw, keys, "left")
    state = F.when(spent(), "TERMINAL_FAILURE").otherwise("RETRYABLE")
    hit = F.col("failed") & (F.col("collector_state") == "COLLECTING")
    return _set(joined, hit, {
        "collector_state": state, "collection_issue_code": safe_code(F.col("raw_issue"))}).select(
        *roots.columns)


def replay_plan(roots: DataFrame, scope: list[str], size: int = MAX_REPLAYS,
                block: int = REPLAY_BLOCK) -> DataFrame:
    """Claimable attempts per scope by ascending task id; a pass replays the first ``size``.

    Positions are counted over blocks of task ids and inside each block, so no task holds a scope.
    """
    rows = roots.filter(claimable()).select(*scope, "dbt_task_run_id").withColumn(
        "replay_block", F.floor(F.col("dbt_task_run_id") / block))
    earlier = Window.partitionBy(*scope).orderBy("replay_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*scope, "replay_block").agg(F.count("*").alias("n")).select(
        *scope, "replay_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy(*scope, "replay_block").orderBy("dbt_task_run_id")
    position = F.col("before") + F.col("nth")
    return rows.withColumn("nth", F.row_number().over(order)).join(offsets, [*scope, "replay_block"]).select(
        *scope, "dbt_task_run_id", position.alias("position"), (position <= size).alias("selected"))


def replay_backlog(roots: DataFrame, scope: list[str], size: int = MAX_REPLAYS) -> DataFrame:
    """Claimable attempts per scope and whether some have to wait for the next pass."""
    return roots.filter(claimable()).groupBy(*scope).agg(
        F.count("*").alias("claimable"),
        F.least(F.count("*"), F.lit(size)).alias("attempted"),
        (F.count("*") > size).alias("backlog"),
    )


def reconcile_summary(roots: DataFrame, scope: list[str], size: int = MAX_REPLAYS) -> DataFrame:
    """Counts per scope; ``attempted`` is what a pass of ``size`` takes on."""
    state = F.col("collector_state")
    return roots.groupBy(*scope).agg(
        F.count("*").alias("discovered"),
        F.least(F.count_if(claimable()), F.lit(size)).alias("attempted"),
        F.count_if(state == "PUBLISHED").alias("published"),
        F.count_if(state == "RETRYABLE").alias("retryable"),
        F.count_if(state == "TERMINAL_FAILURE").alias("terminal_failure"),
        (F.count_if(claimable()) > size).alias("backlog"),
    )


# ---- whole lifecycle from events -------------------------------------------------------------

SALTS = 16


def fold(events: DataFrame, as_of: Column) -> DataFrame:
    """Final state per attempt from its ordered events (attempt, event_id, ts, action).

    At most seven events of an attempt can matter: the discovery and three rounds of claim and
    end. Each round finds the next one as a filtered minimum, so no group is collected or replayed.
    Events are shuffled once, by (attempt, salt), and that exchange serves every round; a hot
    attempt is spread over the salts and meets one state row in each.
    """
    order = F.struct(F.col("ts"), F.col("event_id"))
    salted = events.select(
        "attempt", order.alias("point"), "ts", "action",
        F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int").alias("salt"))
    state = events.groupBy("attempt").agg(
        F.min(F.when(F.col("action") == "discover", order)).alias("at"))
    state = state.select(
        "attempt", "at",
        F.when(F.col("at").isNull(), "ABSENT").otherwise("DISCOVERED").alias("state"),
        F.lit(0).alias("attempts"), F.lit(None).cast(dict(events.dtypes)["ts"]).alias("claimed_at"))

    def next_event(current: DataFrame, states: list[str], wanted: Column) -> DataFrame:
        """Each attempt with the earliest ``wanted`` event after its point, if it is in ``states``."""
        copies = current.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
        e = salted.alias("e")
        match = (
            (F.col("c.attempt") == F.col("e.attempt")) & (F.col("c.s") == F.col("e.salt"))
            & F.col("c.state").isin(states) & (F.col("e.point") > F.col("c.at")) & wanted
        )
        found = F.struct(F.col("e.point").alias("point"), F.col("e.action").alias("action"))
        carried = ("at", "state", "attempts", "claimed_at")
        return copies.alias("c").join(e, match, "left").groupBy(
            F.col("c.attempt").alias("attempt")).agg(
            *(F.max(f"c.{x}").alias(x) for x in carried),
            F.min(F.when(F.col("e.point").isNotNull(), found)).alias("next"))

    hit, action = F.col("next").isNotNull(), F.col("e.action")
    point = F.when(hit, F.col("next.point")).otherwise(F.col("at")).alias("at")
    for number in range(1, MAX_ATTEMPTS + 1):
        claimed = next_event(state, ["DISCOVERED", "RETRYABLE"], action == "claim")
        state = claimed.select(
            "attempt", point, F.when(hit, "COLLECTING").otherwise(F.col("state")).alias("state"),
            F.when(hit, F.lit(number)).otherwise(F.col("attempts")).alias("attempts"),
            F.when(hit, F.col("next.point.ts")).otherwise(F.col("claimed_at")).alias("claimed_at"))
        late = F.col("e.ts") >= F.col("c.claimed_at") + F.expr(LEASE)
        ends = action.isin("fail", "publish") | (action.isin("discover", "tick") & late)
        failed = F.lit("TERMINAL_FAILURE" if number == MAX_ATTEMPTS else "RETRYABLE")
        done = F.when(F.col("next.action") == "publish", "PUBLISHED").otherwise(failed)
        state = next_event(state, ["COLLECTING"], ends).select(
            "attempt", point, F.when(hit, done).otherwise(F.col("state")).alias("state"),
            "attempts", "claimed_at")
    expired = (F.col("state") == "COLLECTING") & (as_of >= F.col("claimed_at") + F.expr(LEASE))
    final = F.when(F.col("attempts") >= MAX_ATTEMPTS, "TERMINAL_FAILURE").otherwise("RETRYABLE")
    return state.select(
        "attempt", F.when(expired, final).otherwise(F.col("state")).alias("state"), "attempts",
        F.col("claimed_at").alias("last_attempted_at"))


# ---- marker lookup ---------------------------------------------------------------------------

def marker_outcome(history: DataFrame, warehouse: str, start: Column, end: Column) -> DataFrame:
    """Outcome class per operation marker within one warehouse and time window.

    Exactly one intact match with a well-formed reference and a known status is conclusive.
    """
    inside = history.filter(
        (F.col("warehouse_id") == warehouse) & F.col("started_at").between(start, end))
    grouped = inside.groupBy("marker").agg(
        F.count_if("marker_intact").alias("matches"),
        F.bool_or(~F.col("marker_intact")).alias("invalid_seen"),
        F.max(F.when(F.col("marker_intact"), F.col("query_reference"))).alias("reference"),
        F.max(F.when(F.col("marker_intact"), F.col("status"))).alias("status"),
    )
    status = F.col("status")
    outcome = (
        F.when(F.col("invalid_seen"), "INVALID_MARKER_INDETERMINATE")
        .when(F.col("matches") == 0, "NOT_FOUND_INDETERMINATE")
        .when(F.col("matches") > 1, "AMBIGUOUS_INDETERMINATE")
        .when(~F.col("reference").rlike("^[A-Za-z0-9-]+$"), "MALFORMED_REFERENCE_INDETERMINATE")
        .when(status == "FINISHED", "UNIQUE_TERMINAL_SUCCESS")
        .when(status == "FAILED", "UNIQUE_TERMINAL_FAILURE")
        .when(status == "CANCELED", "CANCELLATION_NONTERMINAL")
        .when(status.isin("QUEUED", "RUNNING", "STARTED", "COMPILING", "COMPILED"),
              "UNIQUE_NONTERMINAL")
        .otherwise("UNKNOWN_STATUS_INDETERMINATE")
    )
    return grouped.select("marker", "matches", outcome.alias("outcome"))

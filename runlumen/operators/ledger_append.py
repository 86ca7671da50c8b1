"""Appending ledger events: derive server columns, check the rules of each operation, append new ids.

Inputs are rows with the client columns; many entities are appended at once. Every existence rule
reads the ledger through an aggregate or a join keyed by event id or by (entity, generation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlumen.operators import ledger as led
from runlumen.operators.ledger import ACCEPT, CANDIDATE, COLUMNS, GENERATION, REGISTER
from runlumen.session import all_of

SERVER = ["ledger_row_id", "snapshot_id", "payload_digest", "server_record_digest",
          "statement_evaluated_at", "valid_until"]
CLIENT = [c for c in COLUMNS if c not in SERVER]
LINKED = ["candidate_statement_evaluated_at", "roster_statement_evaluated_at"]


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _by_event(inputs: DataFrame, event: str, found: DataFrame) -> DataFrame:
    """``found`` (one row per value of ``event``) next to the inputs, which keep their layout.

    The event may lie in any entity. Ids travel to it and back to the entity of the input; the wide
    inputs do not. Inputs without an entity find nothing; no rule admits them.
    """
    asked = inputs.select("installation_digest", event).dropna().distinct()
    return inputs.join(_to_entities(asked.join(found, event)), ["installation_digest", event], "left")


def _to_entities(narrow: DataFrame) -> DataFrame:
    """Rows laid out by event go back to their entities.

    Left by event, in more partitions than the ledger has buckets, they would draw the wide rows to them.
    """
    return narrow.repartition("installation_digest")


def with_times(inputs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Inputs with the times of their candidate and of their roster anchor, null where there is none."""
    times = ledger.filter(F.col("operation") == CANDIDATE).groupBy("event_id").agg(
        F.min("statement_evaluated_at").alias("at"))
    for event, name in zip(("candidate_event_id", "roster_anchor_event_id"), LINKED, strict=True):
        inputs = _by_event(inputs, event, times.select(
            F.col("event_id").alias(event), F.col("at").alias(name)))
    return inputs


def finalize(inputs: DataFrame, ledger: DataFrame, clock: Column) -> DataFrame:
    """Server columns of input events at one clock; acceptances need their candidate and anchor."""
    accepting = F.col("operation") == ACCEPT
    linked = with_times(inputs.select(*CLIENT), ledger)
    linked = linked.filter(~accepting | all_of([F.col(c).isNotNull() for c in LINKED]))
    hours = F.expr(led.VALID_HOURS)
    limit = F.least(clock + hours, F.col(LINKED[1]) + hours)
    return (
        linked.withColumn("acceptance_digest", F.when(
            accepting, led.digest("acceptance-digest")).otherwise(F.col("acceptance_digest")))
        .withColumn("payload_digest", led.digest("payload-digest"))
        .withColumn("statement_evaluated_at", clock)
        .withColumn("valid_until", F.when(accepting, limit))
        .withColumn("acceptance_statement_evaluated_at", clock)
        .withColumn("snapshot_id", F.when(accepting, led.digest("snapshot-id")))
        .withColumn("server_record_digest", led.digest("server-record"))
        .withColumn("ledger_row_id", led.digest("ledger-row-id"))
        .select(*COLUMNS, *LINKED)
    )


def _sizes(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*GENERATION).agg(F.count("*").alias("generation_rows"))


def register_ok(inputs: DataFrame, ledger: DataFrame) -> DataFrame:
    """No equal or later generation; generation 1 has no prior; n follows the open end of n - 1."""
    newest = ledger.groupBy("installation_digest").agg(F.max("generation").alias("newest"))
    followed = ledger.filter(F.col("predecessor_event_id").isNotNull()).select(
        *GENERATION, "predecessor_event_id").distinct().select(
        "installation_digest", "predecessor_event_id", F.col("generation").alias("t_generation"),
        F.lit(True).alias("followed"))
    ends = led.terminals(ledger).join(
        followed, ["installation_digest", "predecessor_event_id", "t_generation"], "left")
    gen = F.col("generation")
    first = (gen == 1) & F.col("newest").isNull() & all_of(
        [F.col(c).isNull() for c in ("predecessor_event_id", *led.PRIOR)])
    later = (gen > 1) & (F.col("prior_generation") == gen - 1) & F.col("followed").isNull() \
        & led._follows()
    fresh = F.col("newest").isNull() | (F.col("newest") < gen)
    ok = (F.col("event_id") == led.digest("event-id")) & fresh & (first | later)
    joined = inputs.join(newest, "installation_digest", "left").join(
        ends, ["installation_digest", "predecessor_event_id"], "left")
    return joined.select(*inputs.columns, _yes(ok).alias("eligible"))


def candidate_ok(inputs: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row in the generation, a matching valid registration, and the change and anchor rules."""
    valid = led.validated(ledger)
    registration = valid.filter((F.col("operation") == REGISTER) & F.col("row_valid")).select(
        F.col("event_id").alias("predecessor_event_id"), *GENERATION,
        F.col("reason").alias("g_reason"),
        *(F.col(c).alias("g_" + c) for c in ("workspace_digest", "account_digest",
                                             "manifest_digest", "expected_component_count",
                                             "expected_components"))).dropDuplicates(
        ["predecessor_event_id", *GENERATION])
    graph = ["deployment_id", "deployment_mode", "deployment_set_after_digest",
             "stable_graph_digest"]
    prior = ledger.filter(F.col("operation") == ACCEPT).select(
        "installation_digest", (F.col("generation") + 1).alias("generation"),
        *(F.col(c).alias("p_" + c) for c in (*graph, *led.ANCHOR))).distinct()
    # anchors that closed their own generation: exactly three rows, one of each kind
    kinds = ledger.groupBy(*GENERATION).agg(
        F.count("*").alias("n"), F.count_if(F.col("operation") == REGISTER).alias("n_reg"),
        F.max(F.when((F.col("operation") == ACCEPT)
                     & (F.col("candidate_event_id") == F.col("predecessor_event_id")),
                     F.col("candidate_event_id"))).alias("accepted_candidate"))
    anchor = ledger.filter(
        (F.col("operation") == CANDIDATE)
        & (F.col("roster_anchor_event_id") == F.col("event_id"))
        & (F.col("roster_anchor_digest") == F.col("roster_observation_digest"))
    ).join(kinds, GENERATION).filter(
        (F.col("n") == 3) & (F.col("n_reg") > 0)
        & (F.col("accepted_candidate") == F.col("event_id"))
    ).select(F.col("event_id").alias("roster_anchor_event_id"), "installation_digest",
             F.col("statement_evaluated_at").alias("a_time"),
             *(F.col(c).alias("a_" + c) for c in led.ANCHOR_EQUAL if c != "installation_digest"))
    same_registration = all_of([F.col(c) == F.col("g_" + c) for c in (
        "workspace_digest", "account_digest", "manifest_digest", "expected_component_count",
        "expected_components")])
    unchanged = F.col("deployment_set_before_digest") == F.col("deployment_set_after_digest")
    change = (
        (F.col("g_reason") == "UNCHANGED_REFRESH") & (F.col("new_deployment_count") == 0) & unchanged
    ) | (F.col("g_reason").isin(led.CHANGE_REASONS) & (F.col("new_deployment_count") == 1)
         & ~unchanged)
    same_graph = all_of([F.col(c) == F.col("p_" + c) for c in graph])
    at = F.col("statement_evaluated_at")
    reused = all_of([
        F.col("g_reason") == "UNCHANGED_REFRESH", same_graph,
        *(F.col(c) == F.col("a_" + c) for c in led.ANCHOR_EQUAL if c != "installation_digest"),
        *(F.col(c) == F.col("p_" + c) for c in led.ANCHOR),
        F.col("a_time") <= at, at < F.col("a_time") + F.expr(led.VALID_HOURS),
    ])
    own = (F.col("roster_anchor_event_id") == F.col("event_id")) & (
        F.col("roster_anchor_digest") == F.col("roster_observation_digest"))
    digests = [
        F.col("event_id") == led.digest("event-id"),
        F.col("stable_graph_digest") == led.digest("stable-graph"),
        F.col("pre_start_machine_observation_digest") == led.machine_digest("pre_start"),
        F.col("roster_observation_digest") == led.digest("roster-observation"),
        F.col("expected_roster_digest") == F.col("observed_roster_digest"),
        F.col("candidate_digest") == led.digest("candidate-digest"),
    ]
    ok = all_of([F.col("generation_rows") == 1, same_registration, change, *digests,
                 (F.col("new_deployment_count") == 1) | _yes(same_graph), own | _yes(reused)])
    joined = (
        inputs.join(_sizes(ledger), GENERATION, "left")
        .join(registration, ["predecessor_event_id", *GENERATION], "left")
        .join(prior, GENERATION, "left")
        .join(anchor, ["roster_anchor_event_id", "installation_digest"], "left")
    )
    # several prior acceptances of one generation are alternatives, one that fits is enough
    return joined.groupBy(*inputs.columns).agg(F.bool_or(_yes(ok)).alias("eligible"))


def accept_ok(inputs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Two rows in the generation, every repeated column equal, one valid candidate and anchor."""
    rows = led.validated(ledger).filter(F.col("operation") == CANDIDATE)
    # a single candidate names its entity, so that only ids travel; valid ones have an entity
    sole = _to_entities(ledger.filter(F.col("operation") == CANDIDATE).groupBy("event_id").agg(
        F.count("*").alias("n"), F.min("installation_digest").alias("installation_digest")
    ).filter("n = 1").select("event_id", "installation_digest"))
    single = rows.filter("row_valid").select(
        "event_id", *GENERATION, "statement_evaluated_at", *led.ANCHOR,
        led.repeated_digest().alias("c_repeated")).join(
        sole, ["event_id", "installation_digest"], "left_semi")
    candidate = single.select(
        F.col("event_id").alias("candidate_event_id"), *GENERATION,
        F.col("statement_evaluated_at").alias("c_time"), "c_repeated")
    anchor = single.filter(F.col("roster_anchor_event_id") == F.col("event_id")).select(
        F.col("event_id").alias("roster_anchor_event_id"),
        F.col("roster_anchor_digest").alias("a_digest"),
        F.col("statement_evaluated_at").alias("a_time"))
    ok = all_of([
        F.col("event_id") == led.digest("event-id"),
        F.col("acceptance_digest") == led.digest("acceptance-digest"),
        F.col("post_start_machine_observation_digest") == led.machine_digest("post_start"),
        F.col("post_start_machine_observation_digest")
        != F.col("pre_start_machine_observation_digest"),
        F.col("generation_rows") == 2,
        F.col("candidate_event_id") == F.col("predecessor_event_id"),
        F.col("c_time") == F.col(LINKED[0]),
        led.repeated_digest() == F.col("c_repeated"),
        F.col("a_digest") == F.col("roster_anchor_digest"), F.col("a_time") == F.col(LINKED[1]),
    ])
    joined = _by_event(
        inputs.join(_sizes(ledger), GENERATION, "left")
        .join(candidate, ["candidate_event_id", *GENERATION], "left"),
        "roster_anchor_event_id", anchor)
    return joined.select(*inputs.columns, _yes(ok & F.col("c_time").isNotNull()).alias("eligible"))


def invalidate_ok(inputs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Follows an event of the generation that has no successor there."""
    ends = ledger.groupBy(F.col("event_id").alias("predecessor_event_id"), *GENERATION).agg(
        F.collect_set(F.coalesce("snapshot_id", F.lit(""))).alias("snapshots"))
    followed = ledger.filter(F.col("predecessor_event_id").isNotNull()).select(
        *GENERATION, "predecessor_event_id").distinct().withColumn("followed", F.lit(True))
    ok = all_of([
        F.col("event_id") == led.digest("event-id"),
        F.col("predecessor_event_id") == F.col("target_event_id"),
        F.array_contains("snapshots", F.coalesce("target_snapshot_id", F.lit(""))),
        F.col("followed").isNull(),
    ])
    key = ["predecessor_event_id", *GENERATION]
    return inputs.join(ends, key, "left").join(followed, key, "left").select(
        *inputs.columns, _yes(ok).alias("eligible"))


CHECKS = {REGISTER: register_ok, CANDIDATE: candidate_ok, ACCEPT: accept_ok,
          led.INVALIDATE: invalidate_ok}


def append(inputs: DataFrame, ledger: DataFrame, operation: str, clock: Column) -> DataFrame:
    """Rows to append for one kind of event; repeated and ineligible events add nothing."""
    rows = finalize(inputs.filter(F.col("operation") == operation), ledger, clock)
    eligible = CHECKS[operation](rows, ledger).filter("eligible")
    fresh = eligible.join(ledger.select("event_id"), "event_id", "left_anti")
    return fresh.select(*COLUMNS).dropDuplicates(["event_id"])

"""Append-only audit ledger linked by digests, for any entity ("installation") and generation.

A generation is a chain registration -> candidate -> acceptance, optionally closed by an
invalidation. All rules are set-based: chains come from one grouped pivot per (entity, generation)
instead of self-joins, row validity is computed once as a column, existence rules are joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlumen.session import all_of, stage, stage_buckets

REGISTER, CANDIDATE, ACCEPT, INVALIDATE = (
    "MANIFEST_REGISTERED", "TRUST_CANDIDATE", "SNAPSHOT_ACCEPTED", "SNAPSHOT_INVALIDATED")
CONTRACT_VERSION = "ledger.v1"
DOMAIN = "ledger.{}.v1"
QUALIFIER = "ADMIN_ATTESTED_POINT_IN_TIME"
COMPONENT = "BASE_OBSERVABILITY"
VALID_HOURS = "INTERVAL '24' HOUR"
REGISTRATION_REASONS = ["INSTALL", "UPGRADE", "ROLLBACK", "CHANGED_REFRESH", "UNCHANGED_REFRESH"]
CHANGE_REASONS = ["INSTALL", "UPGRADE", "ROLLBACK", "CHANGED_REFRESH"]
INVALIDATION_REASONS = [
    "DEPLOYMENT_RECONCILIATION_FAILED", "FINAL_PLAN_DRIFT", "PRE_START_MISMATCH",
    "ROSTER_REVIEW_FAILED", "START_MISMATCH", "POST_START_MISMATCH", "TRUST_WRITE_INDETERMINATE",
    "OPERATOR_ABORTED",
]

# ---- fixed values: ledger columns by the events that carry them ------------------------------

COMMON = [
    "ledger_row_id", "event_id", "installation_digest", "workspace_digest", "account_digest",
    "generation", "operation", "state", "reason", "contract_version", "manifest_digest",
    "expected_component_count", "expected_components", "payload_digest", "server_record_digest",
    "statement_evaluated_at",
]
GRAPH = [
    "app_digest", "deployment_id", "deployment_mode", "deployment_set_before_digest",
    "deployment_set_after_digest", "new_deployment_count", "direct_plan_digest",
    "direct_lineage_digest", "direct_state_serial", "resource_selection_digest", "source_digest",
    "build_digest", "artifact_digest", "configuration_digest", "app_resource_digest", "acl_digest",
    "job_run_as_digest", "uc_grant_digest", "group_root_digest", "service_principal_set_digest",
    "expected_roster_digest", "observed_roster_digest", "stable_graph_digest",
]
OBSERVED = [
    "pre_start_machine_observation_digest", "pre_start_lifecycle_state",
    "pre_start_active_deployment_id", "pre_start_pending_deployment_count",
    "machine_observer_fingerprint", "roster_observation_digest", "roster_reviewer_fingerprint",
    "roster_anchor_event_id", "roster_anchor_digest", "candidate_digest",
]
CANDIDATE_ONLY = ["predecessor_event_id", "observed_components", *GRAPH, *OBSERVED]
ACCEPTANCE_ONLY = [
    "candidate_event_id", "snapshot_id", "post_start_machine_observation_digest",
    "post_start_lifecycle_state", "post_start_active_deployment_id",
    "post_start_pending_deployment_count", "acceptance_digest", "valid_until",
]
PRIOR = ["prior_generation", "prior_snapshot_id"]
TARGET = ["target_event_id", "target_snapshot_id"]
SIGNATURE = ["client_signer_fingerprint", "client_signature_algorithm", "client_signature"]
COLUMNS = [*COMMON, *CANDIDATE_ONLY, *ACCEPTANCE_ONLY, *PRIOR, *TARGET, *SIGNATURE]
INTEGERS = {
    "generation": "BIGINT", "prior_generation": "BIGINT", "direct_state_serial": "BIGINT",
    "expected_component_count": "INT", "new_deployment_count": "INT",
    "pre_start_pending_deployment_count": "INT", "post_start_pending_deployment_count": "INT",
}
TIMES = ["statement_evaluated_at", "valid_until", "candidate_statement_evaluated_at",
         "roster_statement_evaluated_at", "acceptance_statement_evaluated_at"]
NOT_HEX = {"operation", "state", "reason", "contract_version", "deployment_mode",
           "pre_start_lifecycle_state", "post_start_lifecycle_state", "client_signature_algorithm",
           "client_signature", "deployment_id", "pre_start_active_deployment_id",
           "post_start_active_deployment_id", "expected_components", "observed_components",
           *INTEGERS, *TIMES}
DEPLOYMENT_IDS = ["deployment_id", "pre_start_active_deployment_id",
                  "post_start_active_deployment_id"]
COMPONENTS = ["expected_component_count", "expected_components", "observed_components"]
SCOPE = ["installation_digest", "workspace_digest", "account_digest", "manifest_digest"]
DEPLOYMENT = ["deployment_id", "deployment_mode", "deployment_set_before_digest",
              "deployment_set_after_digest"]
ANCHOR = ["roster_anchor_event_id", "roster_anchor_digest"]
OBSERVERS = ["machine_observer_fingerprint", "roster_reviewer_fingerprint"]
REPEATED = ["workspace_digest", "account_digest", "manifest_digest", *COMPONENTS, *GRAPH, *OBSERVED]
ROSTER = ["account_digest", "workspace_digest", "service_principal_set_digest",
          "expected_roster_digest", "observed_roster_digest", "roster_reviewer_fingerprint"]

# ---- fixed values: fields of each digest -----------------------------------------------------

DIGESTS: dict[str, list[str]] = {
    "event-id": ["contract_version", "installation_digest", "generation", "operation",
                 "predecessor_event_id"],
    "stable-graph": [*SCOPE, "app_digest", "deployment_id", "deployment_mode",
                     "deployment_set_after_digest",
                     *[c for c in GRAPH if c not in (
                         "app_digest", *DEPLOYMENT, "new_deployment_count",
                         "stable_graph_digest")], *COMPONENTS],
    "roster-observation": [*ROSTER, *COMPONENTS],
    "candidate-digest": ["event_id", "predecessor_event_id", *SCOPE, *DEPLOYMENT,
                         "stable_graph_digest", "pre_start_machine_observation_digest",
                         "roster_observation_digest", *ANCHOR, *OBSERVERS, "new_deployment_count",
                         *COMPONENTS],
    "acceptance-digest": ["event_id", "candidate_event_id", "candidate_digest", *SCOPE, *DEPLOYMENT,
                          "stable_graph_digest", "pre_start_machine_observation_digest",
                          "post_start_machine_observation_digest", *ANCHOR, *OBSERVERS,
                          "new_deployment_count", *COMPONENTS, "candidate_statement_evaluated_at",
                          "roster_statement_evaluated_at"],
    "payload-digest": [c for c in COLUMNS if c not in (
        "ledger_row_id", "snapshot_id", "payload_digest", "server_record_digest",
        "statement_evaluated_at", "valid_until", *SIGNATURE)],
    "snapshot-id": ["event_id", "candidate_event_id", "candidate_digest", "acceptance_digest",
                    "payload_digest", "installation_digest", *DEPLOYMENT, "stable_graph_digest",
                    "pre_start_machine_observation_digest",
                    "post_start_machine_observation_digest", *ANCHOR, "generation",
                    "new_deployment_count", *COMPONENTS, "candidate_statement_evaluated_at",
                    "roster_statement_evaluated_at", "acceptance_statement_evaluated_at",
                    "valid_until"],
    "server-record": ["event_id", "payload_digest", "snapshot_id", "statement_evaluated_at",
                      "valid_until"],
    "ledger-row-id": ["event_id", "server_record_digest"],
}
MACHINE = [*SCOPE, "deployment_id", "deployment_mode", "deployment_set_after_digest",
           "stable_graph_digest", "machine_observer_fingerprint"]
MACHINE_STATE = ["lifecycle_state", "active_deployment_id", "pending_deployment_count"]


def column_type(name: str) -> str:
    if name in INTEGERS:
        return INTEGERS[name]
    if name in TIMES:
        return "TIMESTAMP"
    if name == "expected_components":
        return "ARRAY<STRUCT<component_key:STRING,contract_digest:STRING>>"
    if name == "observed_components":
        return ("ARRAY<STRUCT<component_key:STRING,contract_digest:STRING,"
                "observation_digest:STRING>>")
    return "STRING"


# ---- canonical text and digests --------------------------------------------------------------

def _json_text(name: str, column: str | None = None) -> str:
    """SQL text of a JSON value: integers as strings, null literal, UTC microseconds, arrays."""
    column = column or name
    if name in ("expected_components", "observed_components"):
        keys = ["component_key", "contract_digest"]
        if name == "observed_components":
            keys.append("observation_digest")
        pairs = ", ',', ".join(f"""'"{k}":"', c.{k}, '"'""" for k in keys)
        plain = f"'[' || array_join(transform({column}, c -> concat('{{', {pairs}, '}}')), ',') || ']'"
    elif name in TIMES:
        plain = f"""'"' || date_format({column}, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") || '"'"""
    else:
        plain = f"""'"' || CAST({column} AS STRING) || '"'"""
    return f"coalesce({plain}, 'null')"


def json_value(name: str) -> Column:
    """JSON text of a ledger column."""
    return F.expr(_json_text(name))


def _sealed(domain: str, values: dict[str, str]) -> Column:
    """SHA-256 of domain-separated canonical JSON with sorted keys.

    One SQL expression instead of a tree of Python columns: a digest has up to 60 fields.
    """
    body = ", ',', ".join(f"""'"{name}":', {text}""" for name, text in sorted(values.items()))
    tail = '},"domain":"' + DOMAIN.format(domain) + '"}'
    return F.expr(f"""sha2(concat('{{"data":{{', {body}, '{tail}'), 256)""")


def digest(domain: str) -> Column:
    """One of ``DIGESTS`` over the columns of a row."""
    return _sealed(domain, {n: _json_text(n) for n in DIGESTS[domain]})


def machine_digest(phase: str) -> Column:
    """Machine observation before (``pre_start``) or after (``post_start``) the start."""
    values = {n: _json_text(n) for n in MACHINE}
    values |= {n: _json_text(f"{phase}_{n}") for n in MACHINE_STATE}
    values["phase"] = f"""'"{phase.upper()}"'"""
    return _sealed("machine-observation", values)


def repeated_digest() -> Column:
    """SHA-256 of the columns an acceptance repeats from its candidate, to compare them at once."""
    return _sealed("repeated", {n: _json_text(n) for n in REPEATED})


def keep(df: DataFrame, label: str, buckets: int = 0) -> DataFrame:
    """Stage rows several steps read; with ``buckets``, in the layout of a ledger bucketed by entity."""
    if not buckets:
        return stage(df, label)
    return df.sparkSession.table(stage_buckets(df, label, "installation_digest", buckets))


# ---- row rules -------------------------------------------------------------------------------

CHECKED_DIGESTS = {"event-id": "event_id", "payload-digest": "payload_digest",
                   "server-record": "server_record_digest", "ledger-row-id": "ledger_row_id",
                   "stable-graph": "stable_graph_digest",
                   "roster-observation": "roster_observation_digest",
                   "candidate-digest": "candidate_digest"}
# columns of a group that are counted together; the remaining ones differ by operation
_GROUPS = {"common": COMMON, "candidate": [c for c in CANDIDATE_ONLY if c != "predecessor_event_id"],
           "acceptance": ACCEPTANCE_ONLY, "prior": PRIOR}


def with_facts(ledger: DataFrame) -> DataFrame:
    """Facts every row rule reads, each computed once: null counts, patterns, digest matches."""
    first = F.col("expected_components")[0]
    unsigned = all_of([F.col(c).isNull() for c in SIGNATURE])
    signed = all_of([
        F.col("client_signer_fingerprint").isNotNull(),
        F.col("client_signature_algorithm") == "ED25519",
        F.col("client_signature").rlike("^[0-9a-f]{128}$"),
    ])
    hexes = F.expr(f"array_compact(array({', '.join(c for c in COLUMNS if c not in NOT_HEX)}))")
    ids = F.expr(f"array_compact(array({', '.join(DEPLOYMENT_IDS)}))")
    facts = {f"n_{name}": F.expr(f"size(array_compact(array({', '.join(present)})))")
             for name, columns in _GROUPS.items()
             for present in [[f"if({c} IS NULL, NULL, 1)" for c in columns]]}
    facts["shaped"] = all_of([
        F.forall(hexes, lambda h: h.rlike("^[0-9a-f]{64}$")),
        F.forall(ids, lambda h: h.rlike("^[0-9a-f]{32}$")),
        F.col("state") == F.col("operation"), F.col("contract_version") == CONTRACT_VERSION,
        F.col("generation") >= 1, F.col("expected_component_count") == 1,
        F.size("expected_components") == 1, first["component_key"] == COMPONENT,
        first["contract_digest"].rlike("^[0-9a-f]{64}$"), unsigned | signed,
    ])
    for domain, column in CHECKED_DIGESTS.items():
        facts["same_" + column] = F.col(column) == digest(domain)
    for phase in ("pre_start", "post_start"):
        facts[f"same_{phase}"] = F.col(f"{phase}_machine_observation_digest") == machine_digest(
            phase)
    return ledger.withColumns({k: F.coalesce(v, F.lit(False)) if not k.startswith("n_") else v
                               for k, v in facts.items()})


def null_matrix(operation: str) -> Column:
    """Columns an operation must, may and must not carry, over ``with_facts`` rows."""
    full = {name: len(columns) for name, columns in _GROUPS.items()}
    wanted = {"common": full["common"], "candidate": 0, "acceptance": 0}
    if operation in (CANDIDATE, ACCEPT):
        wanted["candidate"] = full["candidate"]
    if operation == ACCEPT:
        wanted["acceptance"] = full["acceptance"]
    rules = [F.col(f"n_{name}") == n for name, n in wanted.items()]
    if operation != REGISTER:
        rules += [F.col("n_prior") == 0, F.col("predecessor_event_id").isNotNull()]
    if operation == INVALIDATE:
        rules.append(F.col("target_event_id").isNotNull())
    else:
        rules += [F.col(c).isNull() for c in TARGET]
    return F.coalesce(all_of([*rules, F.col("operation") == operation, F.col("shaped")]),
                      F.lit(False))


def record_intact() -> Column:
    """Stored payload, record and row digests equal the recomputed ones."""
    return all_of([F.col("same_" + c) for c in (
        "payload_digest", "server_record_digest", "ledger_row_id")])


def integrity() -> Column:
    return F.col("same_event_id") & record_intact()


def _observation_rules() -> list[Column]:
    observed, expected = F.col("observed_components")[0], F.col("expected_components")[0]
    return [
        F.col("deployment_mode") == "SNAPSHOT",
        F.col("new_deployment_count").between(0, 1),
        F.col("direct_state_serial") >= 0,
        F.col("pre_start_lifecycle_state") == "STOPPED",
        F.col("pre_start_active_deployment_id") == F.col("deployment_id"),
        F.col("pre_start_pending_deployment_count") == 0,
        F.size("observed_components") == 1,
        observed["component_key"] == COMPONENT,
        observed["contract_digest"] == expected["contract_digest"],
        observed["observation_digest"].rlike("^[0-9a-f]{64}$"),
        F.col("expected_roster_digest") == F.col("observed_roster_digest"),
        F.col("same_stable_graph_digest"), F.col("same_pre_start"),
        F.col("same_roster_observation_digest"),
    ]


def _start_rules() -> list[Column]:
    return [
        F.col("post_start_lifecycle_state") == "ACTIVE",
        F.col("post_start_active_deployment_id") == F.col("deployment_id"),
        F.col("post_start_pending_deployment_count") == 0,
        F.col("post_start_machine_observation_digest")
        != F.col("pre_start_machine_observation_digest"),
        F.col("same_post_start"),
    ]


def own_valid() -> Column:
    """Validity of a ``with_facts`` row by itself; ``validated`` adds what depends on other rows.

    The digests of an acceptance need the times of its candidate and anchor, so they are checked
    on the chain.
    """
    op, gen = F.col("operation"), F.col("generation")
    no_prior = (F.col("n_prior") == 0) & F.col("predecessor_event_id").isNull()
    registration = [
        null_matrix(REGISTER), integrity(), F.col("reason").isin(REGISTRATION_REASONS),
        (gen == 1) == (F.col("reason") == "INSTALL"),
        F.when(gen == 1, no_prior).otherwise(
            F.col("predecessor_event_id").isNotNull() & (F.col("prior_generation") == gen - 1)),
    ]
    candidate = [null_matrix(CANDIDATE), integrity(), F.col("reason") == "PRE_START_OBSERVED",
                 F.col("observed_ok"), F.col("same_candidate_digest")]
    acceptance = [null_matrix(ACCEPT), F.col("reason") == "POST_START_MATCHED",
                  F.col("observed_ok"), *_start_rules()]
    invalidation = [
        null_matrix(INVALIDATE), integrity(), F.col("reason").isin(INVALIDATION_REASONS),
        F.col("target_event_id") == F.col("predecessor_event_id"),
    ]
    valid = (
        F.when(op == REGISTER, all_of(registration)).when(op == CANDIDATE, all_of(candidate))
        .when(op == ACCEPT, all_of(acceptance)).when(op == INVALIDATE, all_of(invalidation))
    )
    return F.coalesce(valid, F.lit(False))


def terminals(ledger: DataFrame) -> DataFrame:
    """One row per ended event id: where it ended, the snapshot it leaves and its copies."""
    left = F.when(F.col("operation") == ACCEPT, F.col("snapshot_id")).otherwise(
        F.col("target_snapshot_id"))
    return ledger.filter(F.col("operation").isin(ACCEPT, INVALIDATE)).groupBy(
        F.col("event_id").alias("predecessor_event_id"),
        F.col("installation_digest"), F.col("generation").alias("t_generation"),
    ).agg(F.count("*").alias("t_copies"), F.min(left).alias("t_snapshot"),
          F.max(F.col("operation")).alias("t_operation"))


def _follows() -> Column:
    """A registration follows the terminal event joined to it."""
    snapshot = F.when(
        F.col("t_operation") == ACCEPT, F.col("prior_snapshot_id") == F.col("t_snapshot")
    ).otherwise(F.equal_null("prior_snapshot_id", "t_snapshot"))
    return F.coalesce((F.col("t_generation") == F.col("generation") - 1) & snapshot, F.lit(False))


def validated(ledger: DataFrame) -> DataFrame:
    """The ledger with ``row_valid`` and ``intact`` (its record digests), in the ledger's own layout."""
    key = ["predecessor_event_id", "installation_digest"]
    observed = F.coalesce(all_of(_observation_rules()), F.lit(False))
    facts = with_facts(ledger).withColumn("observed_ok", observed)
    own = facts.select(*COLUMNS, own_valid().alias("own"), record_intact().alias("intact"))
    joined = own.join(terminals(ledger), key, "left")
    linked = (F.col("operation") != REGISTER) | (F.col("generation") == 1) | (
        _follows() & (F.col("t_copies") == 1))
    return joined.select(*COLUMNS, "intact", (F.col("own") & linked).alias("row_valid"))


# columns of a validated row that chains and what follows from them read
_SEALS = [c for n in ("acceptance-digest", "snapshot-id") for c in DIGESTS[n]]
CHAIN = [c for c in COLUMNS if c in {
    *_SEALS, *COMMON, *ROSTER, *TARGET, *DEPLOYMENT, "predecessor_event_id", "candidate_event_id",
    "snapshot_id", "prior_snapshot_id", "roster_observation_digest"} - {
    "state", "contract_version", "server_record_digest"}]


def kept_valid(ledger: DataFrame, buckets: int = 0) -> DataFrame:
    """``validated`` staged for chains, invalidations and status: their columns, computed once."""
    return keep(validated(ledger).select(
        *CHAIN, "intact", "row_valid", _repeated().alias("repeated_digest")), "valid", buckets)


def _repeated() -> Column:
    return F.when(F.col("operation").isin(CANDIDATE, ACCEPT), repeated_digest())


# ---- aggregates ------------------------------------------------------------------------------

GENERATION = ["installation_digest", "generation"]


def generation_counts(ledger: DataFrame) -> DataFrame:
    op = F.col("operation")
    return ledger.groupBy(*GENERATION).agg(
        F.count("*").alias("physical_row_count"),
        F.count_if(op == REGISTER).alias("registration_count"),
        F.count_if(op == CANDIDATE).alias("candidate_count"),
        F.count_if(op == ACCEPT).alias("acceptance_count"),
        F.count_if(op == INVALIDATE).alias("invalidation_count"),
        F.count_distinct("event_id").alias("distinct_event_count"),
        F.count_distinct("ledger_row_id").alias("distinct_ledger_row_count"),
        F.count_distinct("snapshot_id").alias("distinct_snapshot_count"),
    )


def latest_generation(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("installation_digest").agg(F.max("generation").alias("generation"))


def event_readback(ledger: DataFrame) -> DataFrame:
    """Stored evidence per event id; a caller requires exactly one physical row.

    Rows meet by event once. There the first row of every value is marked, so that no row is
    repeated for each distinct count.
    """
    shown = ["payload_digest", "server_record_digest", "ledger_row_id", "snapshot_id",
             "statement_evaluated_at", "valid_until"]
    counted = {"payload_digest": "distinct_payload_count",
               "server_record_digest": "distinct_server_record_count",
               "ledger_row_id": "distinct_ledger_row_count"}
    rows = ledger.select("event_id", *shown).repartition("event_id")
    for column, name in counted.items():
        place = F.row_number().over(Window.partitionBy("event_id", column).orderBy(column))
        rows = rows.withColumn(name, F.col(column).isNotNull() & (place == 1))
    return rows.groupBy("event_id").agg(
        F.count("*").alias("physical_row_count"), *(F.min(c).alias(c) for c in shown),
        *(F.count_if(F.col(name)).alias(name) for name in counted.values()))


# ---- chains ----------------------------------------------------------------------------------

def change_rule(reason: Column, row: Column | dict[str, Column]) -> Column:
    """An unchanged refresh deploys nothing new; every other reason deploys exactly one change."""
    same = row["deployment_set_before_digest"] == row["deployment_set_after_digest"]
    return ((reason == "UNCHANGED_REFRESH") & (row["new_deployment_count"] == 0) & same) | (
        reason.isin(CHANGE_REASONS) & (row["new_deployment_count"] == 1) & ~same)


def chains(valid: DataFrame, buckets: int = 0) -> DataFrame:
    """Accepted chains of generations with exactly one registration, candidate and acceptance.

    One aggregate pivots the rows of a generation side by side, only the columns its rules read and
    the acceptance's. A generation with any other row count is excluded, so the single value picked
    per operation is the only one there. What the acceptance repeats is compared by digest.
    """
    op = F.col("operation")
    if "repeated_digest" not in valid.columns:
        valid = valid.select(*CHAIN, "intact", "row_valid", _repeated().alias("repeated_digest"))
    shared = ["event_id", "ledger_row_id", "snapshot_id", "statement_evaluated_at", "row_valid"]
    before = ["workspace_digest", "account_digest", "manifest_digest", "expected_components",
              "predecessor_event_id"]
    wanted = {
        "r": (REGISTER, [*shared, *before, "reason", "prior_snapshot_id"]),
        "c": (CANDIDATE, [*shared, *before, "deployment_set_before_digest", "repeated_digest",
                          "deployment_set_after_digest", "new_deployment_count"]),
        "a": (ACCEPT, [*dict.fromkeys([*shared, *CHAIN, "repeated_digest", "intact"])]),
    }
    picks = [F.max(F.when(op == name, F.col(x))).alias(f"{at}_{x}")
             for at, (name, columns) in wanted.items() for x in columns if x not in GENERATION]
    counts = [F.count("*").alias("n"), *(
        F.count_if(op == name).alias(f"n{i}") for i, name in enumerate((REGISTER, CANDIDATE, ACCEPT)))]
    grouped = valid.groupBy(*GENERATION).agg(*counts, *picks)

    def kinds(x):
        return F.size(F.expr(f"array_distinct(array_compact(array(r_{x}, c_{x}, a_{x})))"))

    def at(row):
        return {x: F.col(f"{row}_{x}") for x in wanted[row][1] if x not in GENERATION}

    r, c, a = at("r"), at("c"), at("a")
    exact = all_of([F.col("n") == 3, F.col("n0") == 1, F.col("n1") == 1, F.col("n2") == 1,
                    kinds("event_id") == 3, kinds("ledger_row_id") == 3, kinds("snapshot_id") == 1])
    linked = all_of([
        c["predecessor_event_id"] == r["event_id"],
        *(c[x] == r[x] for x in ("workspace_digest", "account_digest", "manifest_digest")),
        a["predecessor_event_id"] == c["event_id"], a["candidate_event_id"] == c["event_id"],
        a["statement_evaluated_at"] >= c["statement_evaluated_at"],
        c["statement_evaluated_at"] >= r["statement_evaluated_at"],
        r["expected_components"] == c["expected_components"],
        a["repeated_digest"] == c["repeated_digest"],
        change_rule(r["reason"], c),
        r["row_valid"], c["row_valid"], a["row_valid"],
    ])
    return keep(grouped.filter(exact & F.coalesce(linked, F.lit(False))).select(
        *(F.col(x) if x in GENERATION else a[x].alias(x) for x in CHAIN), a["intact"].alias("intact"),
        r["reason"].alias("registration_reason"), r["event_id"].alias("registration_event_id"),
        r["predecessor_event_id"].alias("registration_predecessor_event_id"),
        r["prior_snapshot_id"].alias("registration_prior_snapshot_id"),
        c["statement_evaluated_at"].alias("candidate_statement_evaluated_at"),
        a["statement_evaluated_at"].alias("acceptance_statement_evaluated_at"),
    ), "chains", buckets)


def derived_valid() -> Column:
    """Digests of an acceptance that depend on candidate and anchor times."""
    limit = F.least(F.col("statement_evaluated_at") + F.expr(VALID_HOURS),
                    F.col("roster_statement_evaluated_at") + F.expr(VALID_HOURS))
    return F.coalesce(all_of([
        F.col("intact"), F.col("valid_until") == limit,
        F.col("acceptance_digest") == digest("acceptance-digest"),
        F.col("snapshot_id") == digest("snapshot-id"),
    ]), F.lit(False))


def original_chains(raw: DataFrame) -> DataFrame:
    """Chains that carry their own roster anchor."""
    own = (F.col("roster_anchor_event_id") == F.col("candidate_event_id")) & (
        F.col("roster_anchor_digest") == F.col("roster_observation_digest"))
    return raw.filter(own).withColumn(
        "roster_statement_evaluated_at", F.col("candidate_statement_evaluated_at")
    ).filter(derived_valid())


ANCHOR_EQUAL = ["installation_digest", "roster_anchor_digest", *ROSTER, "expected_components",
                "observed_components"]


def reused_ready(raw: DataFrame, original: DataFrame) -> DataFrame:
    """Unchanged refreshes that reuse an earlier anchor less than 24 hours old.

    Equality on the anchor event is the join key; the interval is its residual condition.
    """
    o = original.filter(F.col("roster_anchor_event_id") == F.col("candidate_event_id")).select(
        *(F.col(x).alias("o_" + x) for x in ANCHOR_EQUAL),
        F.col("candidate_event_id").alias("o_event"),
        F.col("candidate_statement_evaluated_at").alias("roster_statement_evaluated_at"))
    refreshed = raw.filter((F.col("registration_reason") == "UNCHANGED_REFRESH") & (
        F.col("roster_anchor_event_id") != F.col("candidate_event_id")))
    same = all_of([F.col(x) == F.col("o_" + x) for x in ANCHOR_EQUAL])
    at = F.col("candidate_statement_evaluated_at")
    inside = (F.col("roster_statement_evaluated_at") <= at) & (
        at < F.col("roster_statement_evaluated_at") + F.expr(VALID_HOURS))
    return refreshed.join(o, (F.col("roster_anchor_event_id") == F.col("o_event")) & same & inside) \
        .select(*raw.columns, "roster_statement_evaluated_at")


def prior_chains(raw: DataFrame, buckets: int = 0) -> DataFrame:
    """All chains a later generation may build on: original ones and reused ones."""
    original = original_chains(raw)
    reused = reused_ready(raw, original).filter(derived_valid())
    return keep(original.unionByName(reused), "prior", buckets)


# ---- invalidations, lineage, status ----------------------------------------------------------

def invalidations(valid: DataFrame, prior: DataFrame) -> DataFrame:
    """Valid invalidations: the target is the sole copy, valid itself and last in its generation."""
    ids = valid.groupBy("event_id").agg(F.count("*").alias("copies"))
    sizes = valid.groupBy(*GENERATION).agg(F.count("*").alias("generation_rows"))
    registered = valid.filter((F.col("operation") == REGISTER) & F.col("row_valid")).select(
        F.col("event_id").alias("g_event"), "installation_digest", "generation",
        F.col("expected_components").alias("g_components")).distinct()
    target = valid.filter(F.col("operation") != INVALIDATE).select(
        F.col("event_id").alias("target_event_id"), "installation_digest", "generation",
        F.col("operation").alias("t_operation"), F.col("snapshot_id").alias("t_snapshot"),
        F.col("statement_evaluated_at").alias("t_time"), F.col("row_valid").alias("t_valid"),
        F.col("expected_components").alias("t_components"),
        F.col("predecessor_event_id").alias("t_predecessor"))
    accepted = prior.select(F.col("event_id").alias("p_event"),
                            F.col("snapshot_id").alias("p_snapshot")).distinct()
    rows = valid.filter((F.col("operation") == INVALIDATE) & F.col("row_valid"))
    joined = (
        rows.join(target, ["target_event_id", *GENERATION])
        .join(ids.withColumnRenamed("event_id", "target_event_id"), "target_event_id")
        .join(sizes, GENERATION)
        .join(accepted, (F.col("p_event") == F.col("target_event_id"))
              & (F.col("p_snapshot") == F.col("t_snapshot")), "left")
        .join(registered.withColumnRenamed("installation_digest", "g_inst")
              .withColumnRenamed("generation", "g_gen"),
              (F.col("g_event") == F.col("t_predecessor"))
              & (F.col("g_inst") == F.col("installation_digest"))
              & (F.col("g_gen") == F.col("generation"))
              & (F.col("g_components") == F.col("t_components")), "left")
    )
    op = F.col("t_operation")
    length = F.when(op == REGISTER, 2).when(op == CANDIDATE, 3).when(op == ACCEPT, 4)
    sound = (
        F.when(op == REGISTER, F.col("t_valid"))
        .when(op == CANDIDATE, F.col("t_valid") & F.col("g_event").isNotNull())
        .when(op == ACCEPT, F.col("p_event").isNotNull())
    )
    sole = all_of([
        F.equal_null("t_snapshot", "target_snapshot_id"),
        F.col("statement_evaluated_at") >= F.col("t_time"),
        F.col("expected_components") == F.col("t_components"),
        F.col("copies") == 1, F.col("generation_rows") == length, sound,
    ])
    return joined.filter(F.coalesce(sole, F.lit(False))).select(*CHAIN)


def verified(prior: DataFrame) -> DataFrame:
    """Chains whose anchor holds: their own, or one the generation before already relied on."""
    own = F.col("roster_anchor_event_id") == F.col("candidate_event_id")
    key = ["installation_digest", "generation", "roster_anchor_event_id", "roster_anchor_digest"]
    before = prior.select(
        F.col("installation_digest"), (F.col("generation") + 1).alias("generation"),
        "roster_anchor_event_id", "roster_anchor_digest").distinct()
    reused = prior.filter(~own).join(before, key, "left_semi").select(*prior.columns)
    return prior.filter(own).unionByName(reused)


def lineage(chain: DataFrame, prior: DataFrame, invalid: DataFrame) -> DataFrame:
    """First installs, unchanged refreshes of the same graph, and changes after a valid end."""
    graph = ["deployment_id", "deployment_mode", "deployment_set_after_digest",
             "stable_graph_digest"]
    ends = prior.select(
        F.col("event_id").alias("e_event"), F.col("installation_digest").alias("e_inst"),
        (F.col("generation") + 1).alias("e_gen"), F.col("snapshot_id").alias("e_snapshot"),
        F.lit(True).alias("accepted"), *(F.col(g).alias("e_" + g) for g in graph),
    ).unionByName(invalid.select(
        F.col("event_id").alias("e_event"), F.col("installation_digest").alias("e_inst"),
        (F.col("generation") + 1).alias("e_gen"), F.col("target_snapshot_id").alias("e_snapshot"),
        F.lit(False).alias("accepted"), *(F.lit(None).cast("string").alias("e_" + g) for g in graph),
    ))
    reason = F.col("registration_reason")
    same_graph = all_of([F.col(g) == F.col("e_" + g) for g in graph])
    snapshot = F.when(F.col("accepted"), F.col("e_snapshot") == F.col(
        "registration_prior_snapshot_id")).otherwise(
        F.equal_null("e_snapshot", "registration_prior_snapshot_id"))
    follows = all_of([
        F.col("e_event") == F.col("registration_predecessor_event_id"),
        F.col("e_inst") == F.col("installation_digest"), F.col("e_gen") == F.col("generation"),
        snapshot,
        F.when(reason == "UNCHANGED_REFRESH", F.col("accepted") & same_graph).otherwise(
            reason.isin("UPGRADE", "ROLLBACK", "CHANGED_REFRESH")),
    ])
    first = (F.col("generation") == 1) & (reason == "INSTALL")
    return chain.filter(first).unionByName(chain.filter(~first).join(ends, follows, "left_semi"))


STATUS_COLUMNS = [
    "installation_digest", "workspace_digest", "account_digest", "generation", "snapshot_id",
    *DEPLOYMENT, "stable_graph_digest", "pre_start_machine_observation_digest",
    "post_start_machine_observation_digest", *ANCHOR, "expected_components", "observed_components",
]


def status(ledger: DataFrame, as_of: Column, buckets: int = 0) -> DataFrame:
    """One row per entity whose latest generation is a verified chain; stale at ``valid_until``."""
    valid = kept_valid(ledger, buckets)
    prior = prior_chains(chains(valid, buckets), buckets)
    good = lineage(verified(prior), prior, invalidations(valid, prior))
    newest = good.join(latest_generation(ledger), GENERATION, "left_semi")
    accepted, roster = F.col("statement_evaluated_at"), F.col("roster_statement_evaluated_at")
    return newest.select(
        *STATUS_COLUMNS,
        F.col("candidate_statement_evaluated_at").alias("pre_start_statement_evaluated_at"),
        accepted.alias("post_start_statement_evaluated_at"), "roster_statement_evaluated_at",
        accepted.alias("machine_evidence_at"), roster.alias("roster_evidence_at"),
        F.least(accepted, roster).alias("oldest_evidence_at"), "valid_until",
        as_of.alias("evaluated_at"), F.lit(QUALIFIER).alias("qualifier"),
        F.when(as_of >= F.col("valid_until"), "RUNTIME_TRUST_STALE")
        .otherwise("RUNTIME_TRUST_ACCEPTED_ADMIN_ATTESTED").alias("state"),
    )

"""Registered queries: the audit ledger. The SQL restates every rule with joins and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlumen.operators import ledger as led
from runlumen.operators import ledger_append as app
from runlumen.plans.book import query
from runlumen.plans.derive import DUCK
from runlumen.plans.ledger_data import sql_digest, stored_buckets, stored_ledger, text

L = ["ledger"]
AS_OF = "2024-01-02 12:00:00"  # explicit clock of the status report
ID = ["installation_digest", "generation", "operation", "event_id", "ledger_row_id"]
_ID = ", ".join(ID)
_REG, _CAND, _ACC, _INV = (f"'{x}'" for x in (led.REGISTER, led.CANDIDATE, led.ACCEPT,
                                              led.INVALIDATE))


def _ledger(t):
    return stored_ledger(t.spark, t.sf_dir)


def _dig(domain, prefix="", fixed=None):
    return sql_digest(DUCK, domain, prefix, fixed)


def _machine(phase, prefix=""):
    return sql_digest(DUCK, "machine-observation", prefix, {"phase": phase})


def _isnull(columns, no=""):
    return " AND ".join(f"{c} IS {no} NULL".replace("  ", " ") for c in columns)


def _matrix(op):
    required = list(led.COMMON)
    optional = list(led.SIGNATURE)
    if op == led.REGISTER:
        optional += ["predecessor_event_id", *led.PRIOR]
    if op == led.INVALIDATE:
        required += ["predecessor_event_id", "target_event_id"]
        optional += ["target_snapshot_id"]
    if op in (led.CANDIDATE, led.ACCEPT):
        required += led.CANDIDATE_ONLY
    if op == led.ACCEPT:
        required += led.ACCEPTANCE_ONLY
    absent = [c for c in led.COLUMNS if c not in required + optional]
    hexes = " AND ".join(f"coalesce(regexp_full_match({c}, '[0-9a-f]{{64}}'), TRUE)"
                         for c in led.COLUMNS if c not in led.NOT_HEX)
    ids = " AND ".join(f"coalesce(regexp_full_match({c}, '[0-9a-f]{{32}}'), TRUE)"
                       for c in led.DEPLOYMENT_IDS)
    return f"""({_isnull(required, 'NOT')} AND {_isnull(absent)} AND {hexes} AND {ids}
  AND operation = '{op}' AND state = operation AND contract_version = '{led.CONTRACT_VERSION}'
  AND generation > 0 AND expected_component_count = 1 AND len(expected_components) = 1
  AND expected_components[1].component_key = '{led.COMPONENT}'
  AND regexp_full_match(expected_components[1].contract_digest, '[0-9a-f]{{64}}')
  AND ({_isnull(led.SIGNATURE)} OR (regexp_full_match(client_signer_fingerprint, '[0-9a-f]{{64}}')
    AND client_signature_algorithm = 'ED25519' AND regexp_full_match(client_signature, '[0-9a-f]{{128}}'))))"""


_INTEGRITY = f"""(event_id = {_dig('event-id')} AND payload_digest = {_dig('payload-digest')}
  AND server_record_digest = {_dig('server-record')} AND ledger_row_id = {_dig('ledger-row-id')})"""
_SEEN = f"""(deployment_mode = 'SNAPSHOT' AND new_deployment_count IN (0, 1) AND direct_state_serial >= 0
  AND pre_start_lifecycle_state = 'STOPPED' AND pre_start_active_deployment_id = deployment_id
  AND pre_start_pending_deployment_count = 0 AND len(observed_components) = 1
  AND observed_components[1].component_key = '{led.COMPONENT}'
  AND observed_components[1].contract_digest = expected_components[1].contract_digest
  AND regexp_full_match(observed_components[1].observation_digest, '[0-9a-f]{{64}}')
  AND expected_roster_digest = observed_roster_digest AND stable_graph_digest = {_dig('stable-graph')}
  AND pre_start_machine_observation_digest = {_machine('pre_start')}
  AND roster_observation_digest = {_dig('roster-observation')})"""
VALID = f"""own AS (SELECT *, coalesce(CASE operation
    WHEN {_REG} THEN {_matrix(led.REGISTER)} AND {_INTEGRITY} AND reason IN
      ('INSTALL', 'UPGRADE', 'ROLLBACK', 'CHANGED_REFRESH', 'UNCHANGED_REFRESH')
      AND (reason = 'INSTALL') = (generation = 1) AND CASE WHEN generation = 1 THEN
        predecessor_event_id IS NULL AND prior_generation IS NULL AND prior_snapshot_id IS NULL
        ELSE predecessor_event_id IS NOT NULL AND prior_generation + 1 = generation END
    WHEN {_CAND} THEN {_matrix(led.CANDIDATE)} AND {_INTEGRITY} AND reason = 'PRE_START_OBSERVED'
      AND {_SEEN} AND candidate_digest = {_dig('candidate-digest')}
    WHEN {_ACC} THEN {_matrix(led.ACCEPT)} AND reason = 'POST_START_MATCHED' AND {_SEEN}
      AND post_start_lifecycle_state = 'ACTIVE' AND post_start_active_deployment_id = deployment_id
      AND post_start_pending_deployment_count = 0
      AND post_start_machine_observation_digest <> pre_start_machine_observation_digest
      AND post_start_machine_observation_digest = {_machine('post_start')}
    WHEN {_INV} THEN {_matrix(led.INVALIDATE)} AND {_INTEGRITY} AND target_event_id = predecessor_event_id
      AND reason IN ({', '.join(repr(r) for r in led.INVALIDATION_REASONS)}) END, FALSE) AS own_ok
  FROM ledger),
copies AS (SELECT event_id AS copied, count(*) AS n FROM ledger GROUP BY 1),
valid AS (SELECT o.* EXCLUDE (own_ok), own_ok AND (operation <> {_REG} OR generation = 1 OR EXISTS (
    SELECT 1 FROM ledger p JOIN copies ON copied = p.event_id WHERE p.event_id = o.predecessor_event_id
      AND n = 1 AND p.installation_digest = o.installation_digest AND p.generation = o.generation - 1
      AND ((p.operation = {_ACC} AND p.snapshot_id = o.prior_snapshot_id) OR (p.operation = {_INV}
        AND p.target_snapshot_id IS NOT DISTINCT FROM o.prior_snapshot_id)))) AS row_valid FROM own o)"""
# every generation as one row: its rows in a list and, by operation, its only row of that kind
def _generations(rows="valid", name="gen"):
    one = ", ".join(f"any_value(v) FILTER (operation = {op}) AS {short}, count(*) FILTER (operation = {op}) AS n_{short}"
                    for short, op in (("r", _REG), ("k", _CAND), ("a", _ACC), ("i", _INV)))
    return f"""{name} AS (SELECT installation_digest, generation, list(v) AS rows, count(*) AS n, {one},
  count(DISTINCT event_id) AS events, count(DISTINCT ledger_row_id) AS row_ids,
  count(DISTINCT snapshot_id) AS snapshots
FROM (SELECT *, count(*) OVER (PARTITION BY event_id) AS twins FROM {rows}) v GROUP BY ALL)"""


def _moved(r, c):
    """Whether a registration's reason fits the deployments its candidate saw."""
    return f"""CASE WHEN {r}.reason = 'UNCHANGED_REFRESH' THEN {c}.new_deployment_count = 0
    ELSE {c}.new_deployment_count = 1 END AND {r}.reason IN
    ('INSTALL', 'UPGRADE', 'ROLLBACK', 'CHANGED_REFRESH', 'UNCHANGED_REFRESH')
    AND ({c}.new_deployment_count = 1) = ({c}.deployment_set_before_digest <> {c}.deployment_set_after_digest)"""


def _alike(columns, x, y, test="="):
    return " AND ".join(f"{x}.{c} {test} {y}.{c}" for c in columns)


GEN = _generations()
CHAINS = f"""whole AS (SELECT a.*, r.reason AS registration_reason, r.event_id AS registration_event_id,
    r.predecessor_event_id AS registration_predecessor_event_id,
    r.prior_snapshot_id AS registration_prior_snapshot_id,
    k.statement_evaluated_at AS candidate_statement_evaluated_at,
    a.statement_evaluated_at AS acceptance_statement_evaluated_at
  FROM gen WHERE n = 3 AND events = 3 AND row_ids = 3 AND snapshots = 1
    AND r.row_valid AND k.row_valid AND a.row_valid
    AND [k.predecessor_event_id, a.predecessor_event_id, a.candidate_event_id]
      = [r.event_id, k.event_id, k.event_id]
    AND {_alike(["workspace_digest", "account_digest", "manifest_digest", "expected_components"], "r", "k")}
    AND list_sort([r.statement_evaluated_at, k.statement_evaluated_at, a.statement_evaluated_at])
      = [r.statement_evaluated_at, k.statement_evaluated_at, a.statement_evaluated_at]
    AND {_alike(led.REPEATED, "a", "k", "IS NOT DISTINCT FROM")} AND {_moved("r", "k")})"""
_SEALED = f"""(acceptance_digest = {_dig('acceptance-digest')} AND payload_digest = {_dig('payload-digest')}
  AND snapshot_id = {_dig('snapshot-id')} AND server_record_digest = {_dig('server-record')}
  AND ledger_row_id = {_dig('ledger-row-id')} AND valid_until = INTERVAL 24 HOUR
    + least(statement_evaluated_at, roster_statement_evaluated_at))"""
ANCHORED = f"""anchored AS (SELECT w.*, o.candidate_statement_evaluated_at AS roster_statement_evaluated_at,
    w.roster_anchor_event_id = w.candidate_event_id AS own_anchor,
    w.roster_anchor_digest = w.roster_observation_digest AS own_digest,
    w.registration_reason = 'UNCHANGED_REFRESH' AND {_alike(led.ANCHOR_EQUAL, "o", "w")}
      AND w.candidate_statement_evaluated_at >= o.candidate_statement_evaluated_at
      AND w.candidate_statement_evaluated_at < o.candidate_statement_evaluated_at + INTERVAL 24 HOUR AS may_reuse
  FROM whole w JOIN whole o ON o.candidate_event_id = w.roster_anchor_event_id),
sealed AS (SELECT *, {_SEALED} AS seal FROM anchored),
kinds AS (SELECT *, CASE WHEN own_anchor THEN CASE WHEN own_digest AND seal THEN 'fresh' END
    WHEN may_reuse AND bool_or(own_anchor AND own_digest AND seal) OVER (PARTITION BY roster_anchor_event_id)
    THEN 'reuse' END AS kind FROM sealed),
standing AS (SELECT * FROM kinds WHERE kind IS NOT NULL AND seal)"""
ENDED = f"""ended AS (SELECT i.* FROM (SELECT i, g.n, g.r, list_filter(g.rows, lambda x: x.event_id = i.target_event_id
      AND x.snapshot_id IS NOT DISTINCT FROM i.target_snapshot_id)[1] AS t
    FROM valid i JOIN gen g USING (installation_digest, generation)
    WHERE i.operation = {_INV} AND i.row_valid) q
  WHERE t.twins = 1 AND i.expected_components = t.expected_components
    AND i.statement_evaluated_at >= t.statement_evaluated_at
    AND CASE WHEN t.operation = {_REG} THEN n = 2 AND t.row_valid
      WHEN t.operation = {_CAND} THEN n = 3 AND t.row_valid AND r.row_valid
        AND r.event_id = t.predecessor_event_id AND r.expected_components = t.expected_components
      WHEN t.operation = {_ACC} THEN n = 4 AND t.event_id IN (SELECT event_id FROM standing s
        WHERE s.snapshot_id = t.snapshot_id) ELSE FALSE END)"""
LINEAGE = f"""steps AS (SELECT s.*, lag(s) OVER (PARTITION BY installation_digest ORDER BY generation) AS p
  FROM standing s),
line AS (SELECT s.* FROM (SELECT *, coalesce(p.generation = generation - 1, FALSE) AS follows,
      coalesce(p.event_id = registration_predecessor_event_id AND p.snapshot_id = registration_prior_snapshot_id,
        FALSE) AS named FROM steps) s
  LEFT JOIN ended e ON e.event_id = s.registration_predecessor_event_id
    AND e.installation_digest = s.installation_digest AND e.generation + 1 = s.generation
    AND e.target_snapshot_id IS NOT DISTINCT FROM s.registration_prior_snapshot_id
  WHERE (kind = 'fresh' OR (follows AND {_alike(["roster_anchor_event_id", "roster_anchor_digest"], "p", "s")}))
    AND CASE registration_reason WHEN 'INSTALL' THEN s.generation = 1
      WHEN 'UNCHANGED_REFRESH' THEN follows AND named AND {_alike(
          ["deployment_id", "deployment_mode", "deployment_set_after_digest", "stable_graph_digest"], "p", "s")}
      ELSE (follows AND named) OR e.event_id IS NOT NULL END)"""
ALL = f"WITH {VALID}, {GEN}, {CHAINS}, {ANCHORED}, {ENDED}, {LINEAGE}"
_CHAIN = ["installation_digest", "generation", "event_id", "snapshot_id", "registration_reason",
          "registration_event_id", "candidate_statement_evaluated_at", "valid_until"]
_C = ", ".join(_CHAIN)


def _buckets(t):
    return stored_buckets(t.spark, t.sf_dir)


def _raw(t):
    return led.chains(led.validated(_ledger(t)), _buckets(t))


@query("fn_component_array", L, f"""SELECT {_ID}, expected_components,
  observed_components IS NOT NULL AND list_transform(observed_components, lambda c: struct_pack(
    component_key := c.component_key, contract_digest := c.contract_digest)) = expected_components
    AS contracts_observed FROM ledger""")
def _(t):
    plain = F.transform("observed_components", lambda c: F.struct(
        c["component_key"].alias("component_key"), c["contract_digest"].alias("contract_digest")))
    return _ledger(t).select(*ID, "expected_components", F.coalesce(
        plain == F.col("expected_components"), F.lit(False)).alias("contracts_observed"))


_J = ["generation", "prior_generation", "snapshot_id", "expected_components", "observed_components",
      "statement_evaluated_at", "valid_until"]


@query("fn_ledger_json", L, f"""SELECT {_ID},
  {', '.join(f"{text(DUCK, c, c)} AS json_{c}" for c in _J)} FROM ledger""")
def _(t):
    return _ledger(t).select(*ID, *(led.json_value(c).alias(f"json_{c}") for c in _J))


_D = ["event-id", "payload-digest", "server-record", "ledger-row-id", "stable-graph",
      "roster-observation", "candidate-digest"]


@query("fn_ledger_digests", L, f"""SELECT {_ID},
  {', '.join(f"{_dig(n)} AS {n.replace('-', '_')}_now" for n in _D)},
  {_machine('pre_start')} AS pre_start_now, {_machine('post_start')} AS post_start_now FROM ledger""")
def _(t):
    return _ledger(t).select(
        *ID, *(led.digest(n).alias(n.replace("-", "_") + "_now") for n in _D),
        led.machine_digest("pre_start").alias("pre_start_now"),
        led.machine_digest("post_start").alias("post_start_now"))


@query("led_null_matrix", L, f"""SELECT {_ID}, coalesce(CASE operation
  {' '.join(f"WHEN '{op}' THEN {_matrix(op)}" for op in (led.REGISTER, led.CANDIDATE, led.ACCEPT, led.INVALIDATE))}
  END, FALSE) AS matrix_ok FROM ledger""")
def _(t):
    op, ok = F.col("operation"), F.lit(False)
    for name in (led.REGISTER, led.CANDIDATE, led.ACCEPT, led.INVALIDATE):
        ok = F.when(op == name, led.null_matrix(name)).otherwise(ok)
    return led.with_facts(_ledger(t)).select(*ID, ok.alias("matrix_ok"))


@query("led_integrity", L, f"SELECT {_ID}, coalesce({_INTEGRITY}, FALSE) AS intact FROM ledger")
def _(t):
    return led.with_facts(_ledger(t)).select(*ID, led.integrity().alias("intact"))


@query("led_row_valid", L, f"WITH {VALID} SELECT {_ID}, row_valid FROM valid")
def _(t):
    return led.validated(_ledger(t)).select(*ID, "row_valid")


@query("agg_generation_counts", L, f"""SELECT installation_digest, generation, count(*) AS physical_row_count,
  {', '.join(f"CAST(sum(CASE operation WHEN {op} THEN 1 ELSE 0 END) AS BIGINT) AS {name}_count" for name, op in (
      ("registration", _REG), ("candidate", _CAND), ("acceptance", _ACC), ("invalidation", _INV)))},
  len(list_distinct(list(event_id))) AS distinct_event_count,
  len(list_distinct(list(ledger_row_id))) AS distinct_ledger_row_count,
  len(list_distinct(list(snapshot_id))) AS distinct_snapshot_count FROM ledger GROUP BY ALL""")
def _(t):
    return led.generation_counts(_ledger(t))


@query("agg_latest_generation", L, f"""SELECT {_ID} FROM ledger l WHERE generation = (SELECT max(generation)
  FROM ledger m WHERE m.installation_digest = l.installation_digest)""")
def _(t):
    rows = _ledger(t)
    return rows.join(led.latest_generation(rows), led.GENERATION, "left_semi").select(*ID)


@query("agg_event_readback", L, """SELECT event_id, count(*) AS physical_row_count,
  min(payload_digest) AS payload_digest, min(server_record_digest) AS server_record_digest,
  min(ledger_row_id) AS ledger_row_id, min(snapshot_id) AS snapshot_id,
  min(statement_evaluated_at) AS statement_evaluated_at, min(valid_until) AS valid_until,
  count(DISTINCT payload_digest) AS distinct_payload_count,
  count(DISTINCT server_record_digest) AS distinct_server_record_count,
  count(DISTINCT ledger_row_id) AS distinct_ledger_row_count FROM ledger GROUP BY event_id""")
def _(t):
    return led.event_readback(_ledger(t))


@query("join_ledger_chain", L, f"WITH {VALID}, {GEN}, {CHAINS} SELECT {_C} FROM whole")
def _(t):
    return _raw(t).select(*_CHAIN)


@query("led_chain", L, f"""WITH {VALID}, {GEN}, {CHAINS}
SELECT registration_reason, generation, count(*) AS chains, count(DISTINCT installation_digest) AS entities
FROM whole GROUP BY 1, 2""")
def _(t):
    return _raw(t).groupBy("registration_reason", "generation").agg(
        F.count("*").alias("chains"), F.count_distinct("installation_digest").alias("entities"))


@query("join_ledger_interval", L, f"""{ALL} SELECT {_C}, roster_statement_evaluated_at FROM kinds WHERE kind = 'reuse'""")
def _(t):
    raw = _raw(t)
    return led.reused_ready(raw, led.original_chains(raw)).select(
        *_CHAIN, "roster_statement_evaluated_at")


@query("led_reuse", L, f"""{ALL} SELECT {_C}, kind = 'reuse' AS reused FROM standing""")
def _(t):
    return led.prior_chains(_raw(t), _buckets(t)).select(
        *_CHAIN, (F.col("roster_anchor_event_id") != F.col("candidate_event_id")).alias("reused"))


@query("set_union_chains", L, f"""{ALL} SELECT installation_digest, count(*) AS chains,
  max(generation) AS newest FROM standing GROUP BY 1""")
def _(t):
    return led.prior_chains(_raw(t), _buckets(t)).groupBy("installation_digest").agg(
        F.count("*").alias("chains"), F.max("generation").alias("newest"))


@query("led_invalidations", L, f"{ALL} SELECT {_ID}, target_event_id, target_snapshot_id FROM ended")
def _(t):
    valid = led.kept_valid(_ledger(t), _buckets(t))
    prior = led.prior_chains(led.chains(valid, _buckets(t)), _buckets(t))
    return led.invalidations(valid, prior).select(*ID, "target_event_id", "target_snapshot_id")


@query("led_lineage", L, f"{ALL} SELECT {_C}, roster_statement_evaluated_at FROM line")
def _(t):
    valid = led.kept_valid(_ledger(t), _buckets(t))
    prior = led.prior_chains(led.chains(valid, _buckets(t)), _buckets(t))
    chain = led.lineage(led.verified(prior), prior, led.invalidations(valid, prior))
    return chain.select(*_CHAIN, "roster_statement_evaluated_at")


@query("led_status", L, f"""{ALL}, newest AS (SELECT installation_digest, max(generation) AS generation
  FROM ledger GROUP BY 1)
SELECT {', '.join(led.STATUS_COLUMNS)}, candidate_statement_evaluated_at AS pre_start_statement_evaluated_at,
  statement_evaluated_at AS post_start_statement_evaluated_at, roster_statement_evaluated_at,
  statement_evaluated_at AS machine_evidence_at, roster_statement_evaluated_at AS roster_evidence_at,
  least(statement_evaluated_at, roster_statement_evaluated_at) AS oldest_evidence_at, valid_until,
  TIMESTAMP '{AS_OF}' AS evaluated_at, '{led.QUALIFIER}' AS qualifier,
  CASE WHEN valid_until <= TIMESTAMP '{AS_OF}' THEN 'RUNTIME_TRUST_STALE'
    ELSE 'RUNTIME_TRUST_ACCEPTED_ADMIN_ATTESTED' END AS state
FROM line JOIN newest USING (installation_digest, generation)""")
def _(t):
    return led.status(_ledger(t), F.lit(AS_OF).cast("timestamp_ntz"), _buckets(t))


# ---- appending: the events of a stage against the ledger as it stood before ------------------

def _stage(t, keep, operation):
    rows = _ledger(t)
    target = rows.filter(keep)
    inputs = rows.filter(F.col("operation") == operation)
    return inputs, target


_LINK = """linked AS (SELECT f.*, c.statement_evaluated_at AS candidate_statement_evaluated_at,
    a.statement_evaluated_at AS roster_statement_evaluated_at FROM inputs f
  LEFT JOIN (SELECT event_id, min(statement_evaluated_at) AS statement_evaluated_at FROM target
    WHERE operation = 'TRUST_CANDIDATE' GROUP BY 1) c ON c.event_id = f.candidate_event_id
  LEFT JOIN (SELECT event_id, min(statement_evaluated_at) AS statement_evaluated_at FROM target
    WHERE operation = 'TRUST_CANDIDATE' GROUP BY 1) a ON a.event_id = f.roster_anchor_event_id)"""
_DAY = "INTERVAL 24 HOUR"
_KEEP = {led.REGISTER: "generation = 1", led.CANDIDATE: f"generation = 1 OR operation = {_REG}",
         led.ACCEPT: f"operation IN ({_REG}, {_CAND})", led.INVALIDATE: f"operation <> {_INV}"}
# an input f next to its generation g, the one before h, the newest z, and the rows with its anchor's id
_ASKED = {
    led.REGISTER: f"""CASE WHEN f.generation = 1 THEN z.generation IS NULL AND f.predecessor_event_id IS NULL
      AND f.prior_generation IS NULL AND f.prior_snapshot_id IS NULL
    ELSE z.generation = f.generation - 1 AND f.prior_generation = z.generation
      AND NOT list_contains(list_transform(z.rows, lambda x: x.predecessor_event_id), f.predecessor_event_id)
      AND len(list_filter(z.rows, lambda x: x.event_id = f.predecessor_event_id
        AND CASE x.operation WHEN {_ACC} THEN x.snapshot_id = f.prior_snapshot_id
          WHEN {_INV} THEN x.target_snapshot_id IS NOT DISTINCT FROM f.prior_snapshot_id ELSE FALSE END)) > 0 END""",
    led.CANDIDATE: f"""g.n = 1 AND g.r.row_valid AND g.r.event_id = f.predecessor_event_id
    AND {_alike(["workspace_digest", "account_digest", "manifest_digest", "expected_component_count",
                 "expected_components"], "g.r", "f")} AND {_moved("g.r", "f")}
    AND f.stable_graph_digest = {_dig('stable-graph', 'f.')}
    AND f.pre_start_machine_observation_digest = {_machine('pre_start', 'f.')}
    AND f.roster_observation_digest = {_dig('roster-observation', 'f.')}
    AND f.expected_roster_digest = f.observed_roster_digest
    AND f.candidate_digest = {_dig('candidate-digest', 'f.')}
    AND (f.new_deployment_count = 1 OR len(f.before) > 0)
    AND CASE WHEN f.roster_anchor_event_id = f.event_id THEN f.roster_anchor_digest = f.roster_observation_digest
      ELSE g.r.reason = 'UNCHANGED_REFRESH' AND len(list_filter(anchors, lambda x:
        {_alike(led.ANCHOR_EQUAL, "x", "f")} AND x.operation = {_CAND}
        AND x.roster_anchor_event_id = x.event_id AND x.roster_anchor_digest = x.roster_observation_digest
        AND f.statement_evaluated_at >= x.statement_evaluated_at
        AND f.statement_evaluated_at < x.statement_evaluated_at + {_DAY} AND x.complete
        AND len(list_filter(f.before, lambda y: y.roster_anchor_event_id = x.event_id
          AND y.roster_anchor_digest = x.roster_anchor_digest)) > 0)) > 0 END""",
    led.ACCEPT: f"""g.n = 2 AND g.k.row_valid AND g.k.twins = 1 AND f.acceptance_digest = {_dig('acceptance-digest', 'f.')}
    AND [f.candidate_event_id, f.predecessor_event_id] = [g.k.event_id, g.k.event_id]
    AND f.candidate_statement_evaluated_at = g.k.statement_evaluated_at
    AND {_alike(led.REPEATED, "g.k", "f", "IS NOT DISTINCT FROM")}
    AND f.post_start_machine_observation_digest = {_machine('post_start', 'f.')}
    AND f.post_start_machine_observation_digest <> f.pre_start_machine_observation_digest
    AND len(anchors) = 1 AND anchors[1].row_valid AND anchors[1].operation = {_CAND}
    AND anchors[1].roster_anchor_event_id = anchors[1].event_id
    AND anchors[1].roster_anchor_digest = f.roster_anchor_digest
    AND anchors[1].statement_evaluated_at = f.roster_statement_evaluated_at""",
    led.INVALIDATE: """f.target_event_id = f.predecessor_event_id
    AND len(list_filter(g.rows, lambda x: x.event_id = f.target_event_id
      AND x.snapshot_id IS NOT DISTINCT FROM f.target_snapshot_id)) > 0
    AND NOT list_contains(list_transform(g.rows, lambda x: x.predecessor_event_id), f.predecessor_event_id)""",
}


def _pre_sql(operation):
    tvalid = VALID.replace("FROM ledger", "FROM target").replace(
        "own AS", "town AS").replace("FROM own o", "FROM town o").replace(
        "copies AS", "tcopies AS").replace("JOIN copies", "JOIN tcopies").replace(
        "\nvalid AS", "\ntvalid AS")
    return f"""target AS (SELECT * FROM ledger WHERE {_KEEP[operation]}),
inputs AS (SELECT DISTINCT * FROM ledger WHERE operation = '{operation}'), {tvalid},
{_generations("tvalid", "tgen")},
newest AS (SELECT installation_digest, max(generation) AS generation, max_by(rows, generation) AS rows
  FROM tgen GROUP BY 1),
anchor AS (SELECT x.event_id AS anchor_id, list(struct_insert(x, complete := n = 3 AND n_r = 1 AND n_a = 1
    AND a.candidate_event_id = x.event_id AND a.predecessor_event_id = x.event_id)) AS anchors
  FROM (SELECT unnest(rows) AS x, n, n_r, n_a, a FROM tgen) GROUP BY 1),
{_LINK},
near AS (SELECT l.*, list_filter(coalesce(b.rows, []), lambda x: x.operation = {_ACC}
    AND {_alike(["deployment_id", "deployment_mode", "deployment_set_after_digest", "stable_graph_digest"],
                "x", "l")}) AS before
  FROM linked l LEFT JOIN tgen b ON b.installation_digest = l.installation_digest
    AND b.generation = l.generation - 1),
checked AS (SELECT f.*, coalesce(f.event_id = {_dig('event-id', 'f.')} AND {_ASKED[operation]}, FALSE) AS eligible
  FROM near f LEFT JOIN tgen g USING (installation_digest, generation)
  LEFT JOIN newest z ON z.installation_digest = f.installation_digest
  LEFT JOIN anchor ON anchor_id = f.roster_anchor_event_id)"""


def _pre(name, operation):
    sql = f"""WITH {_pre_sql(operation)} SELECT {_ID}, eligible FROM checked"""
    keep = _KEEP[operation]

    def run(t):
        inputs, target = _stage(t, F.expr(keep), operation)
        linked = app.with_times(inputs.distinct(), target)
        return app.CHECKS[operation](linked, target).select(*ID, "eligible")

    query(name, L, sql)(run)


_pre("led_pre_register", led.REGISTER)
_pre("led_pre_candidate", led.CANDIDATE)
_pre("led_pre_accept", led.ACCEPT)
_pre("led_pre_invalidate", led.INVALIDATE)


@query("led_append", L, f"""WITH {_pre_sql(led.REGISTER)},
added AS (SELECT * FROM checked WHERE eligible AND event_id NOT IN (SELECT event_id FROM target)),
timed AS (SELECT * EXCLUDE (before) REPLACE (TIMESTAMP '{AS_OF}' AS statement_evaluated_at,
  CAST(NULL AS TIMESTAMP) AS valid_until, CAST(NULL AS STRING) AS snapshot_id) FROM added),
paid AS (SELECT * REPLACE ({_dig('payload-digest')} AS payload_digest) FROM timed),
rec AS (SELECT * REPLACE ({_dig('server-record')} AS server_record_digest) FROM paid)
SELECT event_id, installation_digest, generation, operation, payload_digest, server_record_digest,
  {_dig('ledger-row-id')} AS ledger_row_id, statement_evaluated_at FROM rec""")
def _(t):
    inputs, target = _stage(t, F.col("generation") == 1, led.REGISTER)
    clock = F.lit(AS_OF).cast("timestamp_ntz")
    return app.append(inputs, target, led.REGISTER, clock).select(
        "event_id", "installation_digest", "generation", "operation", "payload_digest",
        "server_record_digest", "ledger_row_id", "statement_evaluated_at")


_EXISTS = """SELECT r.workspace_id, r.dbt_task_run_id,
  EXISTS (SELECT 1 FROM {n} n WHERE n.dbt_task_run_id = r.dbt_task_run_id AND n.status IN ('error', 'fail'))
    AS has_failures,
  NOT EXISTS (SELECT 1 FROM {i} i WHERE i.dbt_task_run_id = r.dbt_task_run_id
    AND i.normalized_digest = r.normalized_digest) AS lacks_invocation,
  (SELECT count(*) FROM {n} n WHERE n.dbt_task_run_id = r.dbt_task_run_id
    AND n.resource_type = 'model') AS models
FROM {r} r WHERE r.collector_state = 'PUBLISHED'
  OR EXISTS (SELECT 1 FROM {n} n WHERE n.dbt_task_run_id = r.dbt_task_run_id AND n.failures > 40)"""


@query("join_exists_rules", ["registry", "nodes", "invocations"], """
WITH n AS (SELECT dbt_task_run_id AS k, count(*) FILTER (status IN ('error', 'fail')) AS bad,
    count(*) FILTER (resource_type = 'model') AS models, max(failures) AS most FROM nodes GROUP BY 1),
i AS (SELECT DISTINCT dbt_task_run_id AS k, normalized_digest AS d FROM invocations)
SELECT workspace_id, dbt_task_run_id, coalesce(bad, 0) > 0 AS has_failures, i.k IS NULL AS lacks_invocation,
  coalesce(models, 0) AS models FROM registry r LEFT JOIN n ON n.k = r.dbt_task_run_id
  LEFT JOIN i ON i.k = r.dbt_task_run_id AND i.d = r.normalized_digest
WHERE collector_state = 'PUBLISHED' OR coalesce(most, 0) > 40""")
def _(t):
    return t.spark.sql(_EXISTS, r=t.registry, n=t.nodes, i=t.invocations)

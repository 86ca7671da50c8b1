"""Conversation repair against plain code."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from runlumen.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
SAMPLE = "/root/testdata/sf0.001"


def best_audit(rows):
    """(cost, audit) of rows (initial, fault) by trying edits in order of (cost, audit)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit
        if (i, last) in done:
            continue
        done.add((i, last))
        heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[last]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, NEXT[last]))
                if initial == NEXT[last] or (initial == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initial))


def plain(rows):
    """The whole report of all conversations in plain code."""
    after, ids = {}, {r[0] for r in rows}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        role = "user" if kind == 4 else role
        if kind:
            after.setdefault(conv, []).extend([(turn, role, text)] * (2 if kind == 3 else 1))
    found = {}
    for conv in ids:
        def order(row):
            digest = hashlib.sha256(f"{len(row[1])}:{row[1]}{row[2]}".encode()).digest()
            return row[0] is not None, row[0] or 0, digest
        own = sorted(after.get(conv, []), key=order)
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                          else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit = best_audit([(r[1][:1], f) for r, f in zip(own, faults)])
        lines, last, at = [], "", 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else own[at][1:]
            at += edit != "I"
            if edit != "D":
                role = {"u": "user", "a": "assistant"}[NEXT[last]] if edit in "RI" else role
                lines.append(f"{role}:{text}")
                last = role[0]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in (
                "blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def repaired(spark, df):
    rows = conversations.repair(conversations.damage(df), df).collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def odd_rows():
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(["system", "user", "assistant", "tool", None, ""]),
                         rng.choice(["Yes.", "no", None, "", " \t", f"Text {turn}!", "wait? ", "é漢🙂.", "end\n"])))
    rows += [(None, None, None, None)] * 5 + [(None, 2, "user", "Hi.")] * 7 + [(90, 1, "user", "x." * 20000)]
    # a conversation with a third of all rows, one text repeated at many turns
    rows += [(91, t, "assistant" if t % 2 else "user", "yes." if t % 3 else f"{t}.") for t in range(240)]
    return rows


def test_against_plain_code(spark):
    rows = odd_rows()
    assert repaired(spark, spark.createDataFrame(rows, SCHEMA).repartition(7)) == plain(rows)


def test_registered_query_against_plain_code(spark):
    from runlumen.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SAMPLE}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op11_repair_conversations"](spark, SAMPLE).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == plain(rows) and len(found) == len(plain(rows))


def test_segments_and_partitions_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    many = [rng.integers(0, 16, rng.integers(0, 40)).astype(np.uint8) for _ in range(300)]
    whole = conversations.solve(many)
    for size in (1, 4, 17):
        monkeypatch.setattr(conversations, "SEGMENT", size)
        assert conversations.solve(many) == whole


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repaired(spark, none) == {}
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    names = ["conv", "digest", "code", "audit", "cost", "copies", "kind", "part", "number", "position", "edit"]
    odd = spark.createDataFrame([r + tuple(range(len(names))) for r in rows],
                                SCHEMA + "".join(f", {n} int" for n in names))
    told = conversations.repair(odd, odd).collect()
    assert [(r["audit"], r["cost"]) for r in told] == [("KK", 0)]
    mended = conversations.repaired(odd, conversations.report(odd)).collect()
    assert [(r["position"], r["role"], r["text"], r["edit"]) for r in mended] == [
        (0, "user", "Hi.", "K"), (1, "assistant", "Yes.", "K")]


@pytest.mark.parametrize("size", [1, 50])
def test_equal_rows_cross_stretches(spark, size, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        rows = [(7, t // 2, "user" if t % 2 else "assistant", f"{t}.") for t in range(30)] * 2
        df = spark.createDataFrame(rows, SCHEMA)
        assert repaired(spark, df) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

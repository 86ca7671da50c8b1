"""Conversation structure repair: the cheapest edits that give each conversation a legal shape.

A legal conversation has role initials ``(s?(ua)+)?``. Rows are kept (0), given the role user or
assistant (3) or deleted (4); user and assistant rows without text are inserted anywhere (3). Blank
rows and repeats must be deleted; a truncated row that is not deleted adds 3. Among the cheapest
repairs the one whose edit initials (the audit) are least in ASCII order is taken.

Work is dealt out so that no conversation meets in one task with its texts: repeats are found by
digests (equal rows counted before the shuffle, first turns joined back), rows are put in order by a
range partitioning over (conversation, turn, digest), and each task packs its rows into one code byte
per row. A conversation's codes, as long as its audit, then meet in one task. There a table of costs
is filled from the end, layer by layer (a layer is a place between rows, with four states: nothing yet,
after system, after user, after assistant), and the arcs on cheapest ways are ranked by prefix
doubling: a node's rank by the least 2L edits follows from the ranks by L of the node itself and of
the node L edits on. No node has two arcs with one initial, so the pointer that goes L edits on is
unique; ranks pick the least arc and the doubled pointers read the whole audit. Long conversations
are solved in segments of ``SEGMENT`` rows, carrying the costs back and the state on. Repaired rows
are written by one pass over rows sorted by conversation and order, a row at a time.

Defined results for odd input: a null conversation is one conversation; a null role or text is one
space, hence a null text is blank; null turns come first; rows of equal turn go by the SHA-256 of role
and text; equal rows stand next to each other and all but the first are repeats (or blank). Other
columns are not returned. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlumen.session import stage

SPACE = " \t\n\x0b\x0c\r"
#: Code of a row: initial (0 other, 1 s, 2 u, 3 a) plus 4 times the fault.
BLANK, REPEAT, TRUNCATED = 1, 2, 3
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
KEEP_TO = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
TURN_TO = np.array([2, 2, 3, 2])
LABELS = np.frombuffer(b"DIKR", np.uint8)
FAR = np.int64(1) << 40
SEGMENT = 32768
NAMES = ("conv", "turn", "role", "text")


# ---------------------------------------------------------------- damage


def damage(rows: DataFrame) -> DataFrame:
    """Planned damage to rows (conv_id, turn, role, text) by crc32 of ``conv_id:turn`` modulo 20."""
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")), F.lit(20))
    text = plain("text")
    hit = rows.select("conv_id", "turn", plain("role").alias("role"), text.alias("text"), kind.alias("kind"))
    return hit.filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


# ---------------------------------------------------------------- codes of rows


def _named(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(" "))

    marked = F.concat(F.length(plain(role)).cast("string"), F.lit(":"), plain(role), plain(text))
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), plain(role).alias("role"),
        plain(text).alias("text"), F.unhex(F.sha2(marked.cast("binary"), 256)).alias("digest"))


def _coded(named: DataFrame) -> DataFrame:
    """Distinct (conv, turn, digest) with the code of the first of the equal rows and their number."""
    initial = F.substring("role", 1, 1)
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    own = (F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)).cast("int")
    number = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    packed = named.select("conv", "turn", "digest", number.cast("int").alias("initial"), own.alias("own")).groupBy(
        "conv", "turn", "digest").agg(
        F.first("initial").alias("initial"), F.first("own").alias("own"), F.count("*").alias("copies"))
    # a row whose role and text stand at several turns is new at the first of them only
    again = (packed.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d"))
             .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).filter("turns > 1"))
    met = packed.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    seen = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when((F.col("own") != BLANK) & seen, REPEAT).otherwise(F.col("own"))
    return met.select("conv", "turn", "digest", "copies", (F.col("initial") + 4 * fault).alias("code"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, packed: for each stretch of a conversation its code bytes and its turns."""
    part, number = TaskContext.get().partitionId(), 0
    names = ["conv", "part", "number", "codes", "low", "high", "turns"]
    for batch in batches:
        if not batch.num_rows:
            continue
        copies = batch["copies"].to_numpy()
        code = batch["code"].to_numpy().astype(np.uint8)
        most = 1 << 22
        pieces = np.searchsorted(np.cumsum(copies), np.arange(most, copies.sum(), most))
        for rows in np.split(np.arange(len(code)), np.unique(pieces)):
            if not len(rows):
                continue
            conv, turn = batch["conv"].slice(rows[0], len(rows)), batch["turn"].slice(rows[0], len(rows))
            starts = _changes(conv)
            ends = np.append(starts[1:], len(rows))
            new_turn = np.zeros(len(rows), bool)
            new_turn[_changes(turn)] = True
            new_turn[starts] = True
            new_turn &= turn.is_valid().to_numpy(zero_copy_only=False)
            distinct = np.add.reduceat(new_turn.astype(np.int64), starts)
            value = turn.fill_null(0).to_numpy()
            held = np.add.reduceat((turn.is_valid().to_numpy(zero_copy_only=False)).astype(np.int64), starts)
            own, n = code[rows], copies[rows]
            again = np.where(own >> 2 == BLANK, own, (own & 3) | (REPEAT << 2)).astype(np.uint8)
            codes = np.repeat(again, n)
            codes[np.cumsum(n) - n] = own
            cuts = np.append((np.cumsum(n) - n)[starts], len(codes))
            texts = pa.Array.from_buffers(
                pa.large_binary(), len(starts),
                [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(codes.tobytes())])
            none = held == 0
            yield pa.RecordBatch.from_arrays([
                conv.take(pa.array(starts)), pa.array(np.full(len(starts), part), pa.int32()),
                pa.array(np.arange(number, number + len(starts)), pa.int64()), texts.cast(pa.binary()),
                pa.array(value[ends - held.clip(1)], pa.int64(), mask=none),
                pa.array(value[ends - 1], pa.int64(), mask=none), pa.array(distinct, pa.int64())], names)
            number += len(starts)


def _changes(column: pa.Array) -> np.ndarray:
    """Places where a sorted column starts a new value, null being one."""
    if not len(column):
        return np.zeros(0, np.int64)
    before, after = column.slice(0, len(column) - 1), column.slice(1)
    differ = pa.compute.not_equal(before, after).fill_null(False)
    one_null = pa.compute.xor(before.is_null(), after.is_null())
    return np.append(0, np.flatnonzero(pa.compute.or_(differ, one_null).to_numpy(zero_copy_only=False)) + 1)


# ---------------------------------------------------------------- costs, ranks and audits


def cost_layers(codes: np.ndarray, sizes: np.ndarray, end: np.ndarray | None) -> np.ndarray:
    """Least cost from each (layer, state) to the end, for segments laid one after the other.

    A segment of n rows has n + 1 layers. With ``end`` (costs at the last layer) the segment goes on
    behind it and inserts there belong to what follows; without, conversations end there.
    """
    first = np.append(0, np.cumsum(sizes + 1))
    before = np.append(0, np.cumsum(sizes))
    costs = np.full((first[-1], 4), FAR)
    longest = np.argsort(-sizes, kind="stable")
    live = np.searchsorted(-sizes[longest], -np.arange(sizes.max(initial=0) + 1), "right")
    for behind in range(sizes.max(initial=0) + 1):
        own = longest[:live[behind]]
        layer = first[own] + sizes[own] - behind
        if not behind:
            base = np.tile([0, FAR, FAR, 0], (len(own), 1)) if end is None else end[own]
        else:
            code = codes[before[own] + sizes[own] - behind]
            after = costs[layer + 1]
            fault, to = code >> 2, KEEP_TO[code & 3]
            keep = np.where(to >= 0, np.take_along_axis(after, to.clip(0), 1), FAR)
            stay = np.minimum(keep, after[:, TURN_TO] + 3) + np.where(fault == TRUNCATED, 3, 0)[:, None]
            base = np.minimum(after + 4, np.where(((fault == BLANK) | (fault == REPEAT))[:, None], FAR, stay))
        if behind or end is None:
            base = np.minimum(base, base[:, TURN_TO] + 3)
            base = np.minimum(base, base[:, TURN_TO] + 3)
        costs[layer] = np.minimum(base, FAR)
    return costs


def least_arcs(codes: np.ndarray, sizes: np.ndarray, costs: np.ndarray, closed: bool):
    """For each node (4 * layer + state) its arcs on cheapest ways: targets by initial D, I, K, R; -1 none."""
    first = np.append(0, np.cumsum(sizes + 1))
    layers, last = len(costs), np.zeros(len(costs), bool)
    last[first[1:] - 1] = True
    code = np.zeros(layers, np.int64)
    code[~last] = codes
    fault, node, flat = code >> 2, np.arange(layers)[:, None] * 4, costs.ravel()
    free = ~last & (fault != BLANK) & (fault != REPEAT)
    extra = np.where(fault == TRUNCATED, 3, 0)[:, None]
    state = np.arange(4)

    def arcs(target: np.ndarray, price, allowed: np.ndarray) -> np.ndarray:
        cheapest = flat[target.clip(0, 4 * layers - 1)] + price == costs
        return np.where(allowed & cheapest & (costs < FAR), target, -1).ravel()

    kept = KEEP_TO[code & 3]
    return np.stack([
        arcs(node + 4 + state, 4, ~last[:, None]),
        arcs(node + TURN_TO, 3, (~last | closed)[:, None]),
        arcs(np.where(kept >= 0, node + 4 + kept, -1), extra, free[:, None] & (kept >= 0)),
        arcs(node + 4 + TURN_TO, 3 + extra, free[:, None])])


def audits(arcs: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Least edit initials from each start node, and the node they end at, by prefix doubling."""
    count = arcs.shape[1]
    node = np.arange(count)
    exists = arcs >= 0
    ended = ~exists.any(0)

    def follow(choice: np.ndarray) -> np.ndarray:
        return np.where(ended, node, arcs[choice, node])

    # ranks by one edit; nodes where audits end come before all
    choice = exists.argmax(0)
    rank = np.where(ended, 0, choice + 1)
    pointers, lengths = [follow(choice)], [(~ended).astype(np.int64)]
    while not ended[pointers[-1]].all():
        ahead = pointers[-1]
        _, rank = np.unique(rank * (rank.max() + 1) + rank[ahead], return_inverse=True)
        # among a node's arcs the one with the least initial, then the least rank of what follows
        weight = np.where(exists, np.arange(4)[:, None] * (count + 1) + rank[arcs.clip(0)], 1 << 60)
        chosen = weight.argmin(0)
        if (chosen != choice).any():
            raise AssertionError("two arcs of a node share an initial")
        lengths.append(lengths[-1] + lengths[-1][ahead])
        pointers.append(ahead[ahead])
    total = lengths[-1][starts]
    cuts = np.append(0, np.cumsum(total))
    place = np.arange(cuts[-1]) - np.repeat(cuts[:-1], total)
    at = np.repeat(starts, total)
    for bit, pointer in enumerate(pointers):
        at = np.where(place >> bit & 1, pointer[at], at)
    letters = LABELS[choice[at]].tobytes()
    return [letters[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pointers[-1][starts]


def solve(conversations: list[np.ndarray]) -> list[tuple[int, str]]:
    """(least cost, least audit) of each conversation's codes."""
    found: list[tuple[int, str] | None] = [None] * len(conversations)
    short = [i for i, c in enumerate(conversations) if len(c) <= SEGMENT]
    sizes = np.array([len(conversations[i]) for i in short], np.int64)
    if len(short):
        codes = np.concatenate([conversations[i] for i in short])
        costs = cost_layers(codes, sizes, None)
        begin = np.append(0, np.cumsum(sizes + 1))[:-1]
        texts, _ = audits(least_arcs(codes, sizes, costs, True), 4 * begin)
        for i, text, cost in zip(short, texts, costs[begin, 0]):
            found[i] = int(cost), text.decode()
    for i, codes in enumerate(conversations):
        if found[i] is None:
            found[i] = _solve_long(codes)
    return found


def _solve_long(codes: np.ndarray) -> tuple[int, str]:
    """The same for one long conversation: costs segment by segment backward, audits forward."""
    segments = [codes[a:a + SEGMENT] for a in range(0, len(codes), SEGMENT)]
    ends: list[np.ndarray | None] = [None]
    for segment in segments[::-1]:
        ends.append(cost_layers(segment, np.array([len(segment)]), ends[-1])[:1])
    ends.reverse()
    state, text = 0, []
    for segment, end in zip(segments, ends[1:]):
        sizes = np.array([len(segment)])
        arcs = least_arcs(segment, sizes, cost_layers(segment, sizes, end), end is None)
        letters, exits = audits(arcs, np.array([state]))
        text.append(letters[0])
        state = int(exits[0]) & 3
    return int(ends[0][0, 0]), b"".join(text).decode()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from its stretches in order."""
    def results(held: list) -> pa.RecordBatch:
        codes = [np.frombuffer(b"".join(h[1]), np.uint8) for h in held]
        columns: dict[str, list] = {n: [] for n in REPORT_NAMES}
        for (conv, _, low, high, turns), own, (cost, audit) in zip(held, codes, solve(codes)):
            faults = np.bincount(own >> 2, minlength=4)
            pair = (own[:-1] & 3) * 4 + (own[1:] & 3)
            gaps = 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)
            values = (conv, gaps, int(faults[BLANK]), int(faults[REPEAT]), int(faults[TRUNCATED]),
                      int((~np.isin(pair, (6, 11, 14))).sum()), cost, audit)
            for name, value in zip(REPORT_NAMES, values):
                columns[name].append(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(columns["conv"], kind), *(pa.array(columns[n], pa.int64()) for n in REPORT_NAMES[1:-1]),
             pa.array(columns["audit"], pa.string())], list(REPORT_NAMES))

    held: list = []
    kind, bytes_held = pa.null(), 0
    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, codes, low, high, turns in zip(*(batch[n].to_pylist() for n in ("conv", "codes", "low", "high", "turns"))):
            if not held or held[-1][0] != conv:
                if bytes_held >= SEGMENT:
                    yield results(held)
                    held, bytes_held = [], 0
                held.append([conv, [codes], low, high, turns])
            else:
                last = held[-1]
                last[1].append(codes)
                if low is not None:
                    # a turn that goes on across two stretches counts once
                    last[4] += turns - (last[3] == low)
                    last[2], last[3] = low if last[2] is None else last[2], high
            bytes_held += len(codes)
    if held:
        yield results(held)


REPORT_NAMES = ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Of each conversation with rows: gaps, faults, illegal neighbours, cost and audit."""
    coded = _coded(_named(rows, conv, turn, role, text))
    order = ["conv", "turn", "digest"]
    kind = coded.schema["conv"].dataType.simpleString()
    runs = coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _runs, f"conv {kind}, part int, number long, codes binary, low long, high long, turns long")
    longs = ", ".join(f"{n} long" for n in REPORT_NAMES[1:-1])
    return (runs.repartition("conv").sortWithinPartitions("conv", "part", "number")
            .mapInArrow(_reports, f"conv {kind}, {longs}, audit string").withColumnRenamed("conv", conv))


# ---------------------------------------------------------------- repaired rows


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, each conversation's audit before its rows."""
    started, conv, audit, at, place, last = False, None, "", 0, 0, ""
    out: list[tuple] = []
    kind, size = pa.null(), 0

    def turned() -> str:
        return "assistant" if last == "u" else "user"

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", "position", "role", "text", "edit"])

    for batch in batches:
        kind = batch.schema.field("conv").type
        for key, its_audit, role, text in zip(*(batch[n].to_pylist() for n in ("conv", "audit", "role", "text"))):
            if its_audit is not None:
                started, conv, audit, at, place, last = True, key, its_audit, 0, 0, ""
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    role = turned() if edit == "R" else role
                    out.append((conv, place, role, text, edit))
                    last, place, size = role[:1], place + 1, size + len(text)
            while started and audit[at:at + 1] == "I":
                role = turned()
                out.append((conv, place, role, "", "I"))
                last, place, at = role[:1], place + 1, at + 1
            if len(out) >= 4096 or size >= 1 << 24:
                yield batch_of()
                out, size = [], 0
    if out:
        yield batch_of()


def repaired(rows: DataFrame, reports: DataFrame, conv: str = "conv_id", turn: str = "turn",
             role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conversation, position, role, text, edit) after the edits of ``report``.

    Conversations come whole and in order within a partition; deleted rows do not come.
    """
    named = _named(rows, conv, turn, role, text)
    kind = named.schema["conv"].dataType.simpleString()
    told = reports.select(F.col(conv).alias("conv"), "audit")
    none = F.lit(None)
    both = told.select(
        "conv", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("binary").alias("digest"),
        "audit", none.cast("string").alias("role"), none.cast("string").alias("text"),
    ).unionByName(named.select("conv", F.lit(1).alias("kind"), "turn", "digest",
                               none.cast("string").alias("audit"), "role", "text"))
    return (both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "digest")
            .select("conv", "audit", "role", "text")
            .mapInArrow(_repaired, f"conv {kind}, position long, role string, text string, edit string")
            .withColumnRenamed("conv", conv))


def digests(mended: DataFrame, conv: str = "conv_id") -> DataFrame:
    """SHA-256 of the newline-joined ``role:text`` of each conversation of ``repaired``.

    The rows must come as ``repaired`` returns them: a conversation whole and in order in a partition.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = None
        for batch in batches:
            keys, sums = [], []
            for key, place, role, text in zip(*(batch[n].to_pylist() for n in ("conv", "position", "role", "text"))):
                if not place:
                    if sha is not None:
                        keys.append(current)
                        sums.append(sha.hexdigest())
                    current, sha = key, hashlib.sha256()
                sha.update((("\n" if place else "") + f"{role}:{text}").encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.field("conv").type), pa.array(sums, pa.string())], ["conv", "sha256"])
            kind = batch.schema.field("conv").type
        if sha is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([current], kind), pa.array([sha.hexdigest()])], ["conv", "sha256"])

    kind = mended.schema[conv].dataType.simpleString()
    return (mended.withColumnRenamed(conv, "conv").mapInArrow(run, f"conv {kind}, sha256 string")
            .withColumnRenamed("conv", conv))


def repair(rows: DataFrame, ids: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """For each conversation of ``ids`` the report on its rows and the digest of the repaired rows."""
    told = stage(report(rows, conv, turn, role, text), "conversation-reports")
    sums = digests(repaired(rows, told, conv, turn, role, text), conv)
    wanted = ids.select(F.col(conv).alias("wanted")).distinct()
    told, sums = told.withColumnRenamed(conv, "told"), sums.withColumnRenamed(conv, "summed")
    empty = hashlib.sha256().hexdigest()
    return (wanted.join(told, F.col("wanted").eqNullSafe(F.col("told")), "left")
            .join(sums, F.col("wanted").eqNullSafe(F.col("summed")), "left")
            .select(F.col("wanted").alias(conv),
                    *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in REPORT_NAMES[1:-1]),
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256")))

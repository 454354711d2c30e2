"""Conversation structure repair over one suffix-shared automaton.

A conversation's rows become a signature: one symbol per row, of its role's initial and its fault.
A row must go (blank, duplicate), is truncated, or is sound; the initial matters where the row may
stay. Edits turn the roles into ``(s?(ua)+)?`` at least cost: Keep 0, Rerole 3, Delete 4, Insert 3,
and 3 more for a truncated row that is not deleted. Of equally cheap audits (the edits' initials)
the ASCII-least one is taken.

1. Signatures are cut from the end into blocks of at most ``BLOCK`` symbols. Only distinct blocks go
   on, however many conversations share them.
2. Read from the end, equal suffixes of blocks are one node of an automaton. The blocks are sorted
   by their reversed symbols over ranges of partitions, so the path of nodes that a block shares
   with the one before it stays in place and every node is met once (but for the path at the start
   of a partition). Per node and grammar state the cost to go and the best audit suffix follow from
   those of the node behind it.
3. A conversation's last block ends in an accepted state; of the others costs and audits are kept
   for each state in which they may end. Conversations of several blocks join them from the end.
4. Audits are applied to the rows in a streaming pass sorted by conversation: neither its rows nor
   its texts are ever gathered, however long it is. Sorting and windows spill to disk.

Two audits of equal cost for the same rows are never prefixes of one another, as the longer one
would insert more, so the least suffix of a node is part of the least audit.

Defined results: rows of one turn stand in the order of role and text, null turns first. A null
role or text counts as one space, a null ``conv_id`` is a conversation of its own. A row whose role
has another initial than s, u or a cannot be kept. Repeated rows are rows of their own; the later
ones are duplicates. Very long texts pass through as they are. Only the four columns are read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardlens.llm.common import bounded_batches, read_table, scratch, store

#: Symbols per block: bounds what a task holds of one conversation.
BLOCK = 256
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Grammar states: start, after s, after u, after a. A conversation ends at the start or after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES, ACCEPTED = (START, AFTER_S, AFTER_U, AFTER_A), (START, AFTER_A)
#: Where an initial leads to, by state.
KEPT = {
    "s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A},
}
#: Where a row of the role that the grammar expects leads to.
EXPECTED = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
ROLE_INTO = {AFTER_U: "user", AFTER_A: "assistant"}
#: Symbol of a row that must go; others are an initial (``x`` for any that the grammar has not),
#: upper-case if the row is truncated.
GONE = "-"

NEVER = 1 << 60
SPACES = " \t\n\x0b\f\r"

#: Cost and audit of each state up to one end.
Suffix = list[tuple[int, str]]


def _inserted(values: Suffix) -> Suffix:
    """Allow rows to be inserted before what follows; two inserts lead through all states."""
    for _ in range(3):
        values = [
            min(values[s], (INSERT + values[EXPECTED[s]][0], "I" + values[EXPECTED[s]][1])) for s in STATES
        ]
    return values


def ends(inner: bool) -> list[Suffix]:
    """Values behind the last symbol: of the accepted states, or one table for each end state."""
    wanted = [{state} for state in STATES] if inner else [set(ACCEPTED)]
    return [_inserted([(0, "") if s in states else (NEVER, "") for s in STATES]) for states in wanted]


def extend(symbol: str, behind: Suffix) -> Suffix:
    """Values before a row, from those behind it."""
    values = []
    initial = symbol.lower()
    more = TRUNCATED if symbol != initial else 0
    for state in STATES:
        options = [(DELETE + behind[state][0], "D" + behind[state][1])]
        if symbol != GONE:
            into = EXPECTED[state]
            options.append((REROLE + more + behind[into][0], "R" + behind[into][1]))
            into = KEPT.get(initial, {}).get(state)
            if into is not None:
                options.append((more + behind[into][0], "K" + behind[into][1]))
        values.append(min(options))
    return _inserted(values)


def _automaton(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of sorted blocks; the nodes of the current path are all that is held."""
    path: list[list[Suffix]] = []
    before: tuple[bool, str] | None = None
    for batch in batches:
        costs, audits = [], []
        for inner, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if before is None or before[0] != inner:
                path, shared = [ends(inner)], 0
            else:
                shared, most = 0, min(len(block), len(before[1]))
                while shared < most and block[shared] == before[1][shared]:
                    shared += 1
                del path[shared + 1 :]
            for symbol in block[shared:]:
                path.append([extend(symbol, behind) for behind in path[-1]])
            before = (inner, block)
            costs.append([cost for values in path[-1] for cost, _ in values])
            audits.append([audit for values in path[-1] for _, audit in values])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
            ["inner", "block", "costs", "audits"],
        )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits of conversations of several blocks, which come sorted from the last block on."""
    current: tuple | None = None
    #: Per state its cost and its pieces, as (piece, pieces behind it).
    values: list[tuple[int, tuple | None]] = []
    blocks = 0

    def pieces() -> Iterator[tuple]:
        cost, chain = values[START]
        for number in range(blocks - 1, -1, -1):
            piece, chain = chain
            yield current[0], number, piece, cost

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "number", "piece", "cost"])

    done: list[tuple] = []
    for batch in batches:
        for conv_id, costs, audits in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "costs", "audits"))):
            table = [list(zip(costs[at : at + 4], audits[at : at + 4])) for at in range(0, len(costs), 4)]
            if current is None or current[0] != conv_id:
                done += pieces() if current is not None else []
                current, blocks = (conv_id,), 1
                values = [(cost, (piece, None)) for cost, piece in table[0]]
            else:
                best = [
                    min((table[end][s][0] + values[end][0], table[end][s][1], end) for end in STATES) for s in STATES
                ]
                values, blocks = [(cost, (piece, values[end][1])) for cost, piece, end in best], blocks + 1
            if len(done) >= 10_000:
                yield batch_of(done)
                done = []
    yield batch_of(done + (list(pieces()) if current is not None else []))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows, from audit pieces that each precede the rows of their block."""
    current: tuple | None = None
    state, place, piece, at = START, 0, "", 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "place", "role", "text", "edit"])

    def inserts() -> Iterator[tuple]:
        nonlocal state, place, at
        while at < len(piece) and piece[at] == "I":
            state, at, place = EXPECTED[state], at + 1, place + 1
            yield current[0], place, ROLE_INTO[state], "", "I"

    for batch in batches:
        done: list[tuple] = []
        for conv_id, given, role, text in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "piece", "role", "text"))):
            if given is not None:
                if current is not None:
                    done += inserts()
                if current is None or current[0] != conv_id:
                    current, state, place = (conv_id,), START, 0
                piece, at = given, 0
                continue
            done += inserts()
            edit, at = piece[at], at + 1
            if edit == "D":
                continue
            state = EXPECTED[state] if edit == "R" else KEPT[role[:1]][state]
            place += 1
            done.append((conv_id, place, ROLE_INTO[state] if edit == "R" else role, text, edit))
        yield batch_of(done)
    if current is not None:
        yield batch_of(list(inserts()))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines, from rows in order."""
    current, digest = None, hashlib.sha256()
    for batch in batches:
        ids, digests = [], []
        for conv_id, role, text in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "role", "text"))):
            if current is None or current[0] != conv_id:
                if current is not None:
                    ids.append(current[0])
                    digests.append(digest.hexdigest())
                current, digest = (conv_id,), hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], ["conv_id", "digest"])
    if current is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([current[0]], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "digest"]
        )


def signed_rows(turns: DataFrame) -> DataFrame:
    """``conv_id, back, turn, role, text, fault, symbol, adjoins, new_turn``.

    ``back`` counts a conversation's rows from its last one, which is 1. ``adjoins`` says that the
    row before may stand before it, ``new_turn`` that it is the first row of a turn.
    """
    order = Window.partitionBy("conv_id").orderBy(F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    initial = F.substring("role", 1, 1)
    earlier = F.lead(initial, 1).over(order)
    rows = rows.select(
        "*", F.row_number().over(order).cast("long").alias("back"),
        F.concat(earlier, initial).isin("su", "ua", "au").alias("adjoins"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lead("turn", 1).over(order))).alias("new_turn"),
        F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("said"),
    )
    # Already dealt by conversation, so this sorts but does not shuffle.
    said = Window.partitionBy("conv_id", "said").orderBy(F.desc("back"))
    visible = F.btrim("text", F.lit(SPACES))
    fault = (
        F.when(visible == "", "blank").when(F.row_number().over(said) > 1, "duplicate")
        .when(~F.right(visible, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    rows = rows.withColumn("fault", fault)
    return rows.select(
        "conv_id", "back", "turn", "role", "text", "fault",
        F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(known))
        .otherwise(known).alias("symbol"),
        "adjoins", "new_turn",
    )


def plan_repairs(rows: DataFrame, folder: str) -> DataFrame:
    """``conv_id, number, piece, cost``: the cheapest audit, in pieces by block from the end (0),
    and what the whole of it costs. ``rows`` are those of ``signed_rows``."""
    spark = bounded_batches(rows.sparkSession)
    blocks = store(
        rows.groupBy("conv_id", F.floor((F.col("back") - 1) / BLOCK).alias("number"))
        .agg(F.array_sort(F.collect_list(F.struct("back", "symbol"))).alias("all"))
        .select("conv_id", "number", (F.col("number") > 0).alias("inner"), F.array_join("all.symbol", "").alias("block")),
        f"{folder}/blocks",
    )
    distinct = blocks.select("inner", "block").distinct()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    automaton = store(
        distinct.repartitionByRange(partitions, "inner", "block").sortWithinPartitions("inner", "block")
        .mapInArrow(_automaton, "inner boolean, block string, costs array<long>, audits array<string>"),
        f"{folder}/automaton",
    )
    long = store(
        blocks.groupBy("conv_id").agg(F.max("number").alias("last")).filter("last > 0").select(F.col("conv_id").alias("long_id")),
        f"{folder}/long",
    )
    valued = blocks.join(automaton, ["inner", "block"])
    several = F.col("conv_id").eqNullSafe(F.col("long_id"))
    single = valued.join(long, several, "left_anti").select(
        "conv_id", "number", F.col("audits")[START].alias("piece"), F.col("costs")[START].alias("cost")
    )
    joined = (
        valued.join(long, several, "left_semi").select("conv_id", "number", "costs", "audits")
        .repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "number")
        .mapInArrow(_joined, "conv_id long, number long, piece string, cost long")
    )
    return store(single.unionByName(joined), f"{folder}/audits")


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, place, role, text, edit``: the rows that stay or come in, from place 1 on.

    The rows of a conversation follow each other in one partition, in order.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = audits.select("conv_id", "number", "piece", F.lit(None).cast("long").alias("back"),
                         F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    given = rows.select("conv_id", F.floor((F.col("back") - 1) / BLOCK).alias("number"),
                        F.lit(None).cast("string").alias("piece"), "back", "role", "text")
    return (
        told.unionByName(given).repartition(partitions, "conv_id")
        .sortWithinPartitions("conv_id", F.desc("number"), F.desc_nulls_first("back"))
        .select("conv_id", "piece", "role", "text")
        .mapInArrow(_apply, "conv_id long, place long, role string, text string, edit string")
    )


def repairs(turns: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cheapest audit and a digest of the repaired text.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    """
    spark = bounded_batches(turns.sparkSession)
    folder = scratch(spark, "repair")
    rows = store(signed_rows(turns), f"{folder}/rows")
    audits = plan_repairs(rows, folder)
    digests = repaired_turns(rows, audits).mapInArrow(_digest, "conv_id long, digest string")
    whole = audits.groupBy("conv_id").agg(
        F.max("cost").alias("cost"),
        F.array_join(F.reverse(F.array_sort(F.collect_list(F.struct("number", "piece"))))["piece"], "").alias("audit"),
    )
    fault = lambda name: F.count_if(F.coalesce(F.col("fault") == name, F.lit(False))).alias(name)
    counted = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0).cast("long")).alias("gaps"),
        fault("blank"), fault("duplicate"), fault("truncated"), F.count_if(~F.col("adjoins")).alias("illegal"),
    )
    audited, digested = whole.withColumnRenamed("conv_id", "audit_id"), digests.withColumnRenamed("conv_id", "digest_id")
    return (
        counted.join(audited, F.col("conv_id").eqNullSafe(F.col("audit_id")))
        .join(digested, F.col("conv_id").eqNullSafe(F.col("digest_id")), "left")
        .select(
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
            F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with the faults that the query plants, chosen by a checksum of conversation and turn."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text: Column = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time"),
    ).drop("time")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repairs(damaged(turns)).withColumnRenamed("conv_id", "found_id")
    every = turns.select("conv_id").distinct()
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )

"""Structure repair against a search over all edits of each conversation."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hazardlens.llm import repair

TURNS = "conv_id long, turn long, role string, text string"
ROLE_INTO = {2: "user", 3: "assistant"}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def damage(rows):
    out = {}
    for conv_id, turn, role, text in rows:
        kept = out.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        visible = text.strip(" \t\n\x0b\f\r")
        if not visible:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """The first goal that a search by (cost, audit) reaches."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", at, NEXT[state]))
        if at < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if found[at] not in ("blank", "duplicate"):
                more = 3 if found[at] == "truncated" else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, NEXT[state]))
                kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(rows[at][1][:1], {}).get(state)
                if kept is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, kept))


def repaired(rows, audit):
    state, at, said = 0, 0, []
    for edit in audit:
        if edit == "K":
            state = {"s": 1, "u": 2, "a": 3}[rows[at][1][0]]
            said.append(f"{rows[at][1]}:{rows[at][2]}")
        elif edit != "D":
            state = NEXT[state]
            said.append(f"{ROLE_INTO[state]}:{rows[at][2] if edit == 'R' else ''}")
        at += edit != "I"
    return "\n".join(said)


def expected(rows, damaged=True):
    by = damage(rows) if damaged else {}
    if not damaged:
        for conv_id, turn, role, text in rows:
            by.setdefault(conv_id, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv_id, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        found = faults(own)
        cost, audit = cheapest(own, found)
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[found.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
            cost, audit, hashlib.sha256(repaired(own, audit).encode()).hexdigest(),
        )
    return out


def found(frame):
    rows = frame.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def awkward():
    pick = random.Random(3)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "été"]
    texts = ["a.", "b", "", "  ", None, "c!  ", "d?", "e.x", "a.", " \n", "日本。", "🙂!"]
    rows = [
        (conv_id if conv_id % 40 else None, pick.choice([turn, turn, turn, None, pick.randint(0, 5)]), pick.choice(roles), pick.choice(texts))
        for conv_id in range(1200) for turn in range(pick.randint(0, 9))
    ]
    rows += [(9000, i, pick.choice(["user", "assistant"]), pick.choice([f"yes {i}.", f"no {i}", "", "x."])) for i in range(1500)]
    rows += [(9001, 0, "user", "long text " * 300_000), (9001, 1, "assistant", "ok.")]
    rows += [(9002, 1, "user", "again.")] * 600
    return rows


def test_damaged_awkward_conversations(spark, tmp_path):
    rows = awkward()
    frame = spark.createDataFrame(rows, TURNS).withColumns({"block": F.lit("x"), "back": F.lit(1), "piece": F.lit("y")})
    frame.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(repair.op11_structure_repair(spark, str(tmp_path))) == expected(rows)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_blocks_do_not_change_the_repair(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = [r for r in awkward() if r[0] is None or r[0] < 300 or r[0] == 9002]
    frame = spark.createDataFrame(rows, TURNS).repartition(4)
    assert found(repair.repairs(frame)) == expected(rows, damaged=False)


def test_all_signatures_of_five_rows():
    """Every short signature through the automaton, in the order that its tasks see them."""
    import itertools

    import pyarrow as pa

    symbols = "-suaxSUAX"
    blocks = sorted("".join(s) for n in range(1, 6) for s in itertools.product(symbols, repeat=n))
    batch = pa.RecordBatch.from_arrays([pa.array([False] * len(blocks)), pa.array(blocks)], ["inner", "block"])
    rows = list(repair._automaton(iter([batch.slice(0, 1000), batch.slice(1000)])))
    values = [v for b in rows for v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())]
    assert len(values) == len(blocks)
    for block, costs, audits in values[::37]:
        forward = block[::-1]
        own = [(i, s.lower(), str(i)) for i, s in enumerate(forward)]
        fault = ["blank" if s == "-" else "truncated" if s.isupper() else "" for s in forward]
        assert (costs[0], audits[0]) == cheapest(own, fault)


def test_no_conversations(spark, tmp_path):
    frame = spark.createDataFrame([], TURNS)
    assert repair.repairs(frame).collect() == []
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op11_structure_repair(spark, str(tmp_path)).collect() == []


def test_repaired_rows_keep_their_texts(spark, tmp_path):
    rows = [(1, 0, "assistant", "hi there."), (1, 1, "user", "well"), (2, 0, "user", " "), (3, 0, "system", "be kind."), (3, 4, "user", "hm?")]
    signed = repair.signed_rows(spark.createDataFrame(rows, TURNS))
    audits = repair.plan_repairs(signed, str(tmp_path))
    out = sorted(tuple(r) for r in repair.repaired_turns(signed, audits).collect())
    assert out == [
        (1, 1, "user", "", "I"), (1, 2, "assistant", "hi there.", "K"),
        (3, 1, "system", "be kind.", "K"), (3, 2, "user", "hm?", "K"), (3, 3, "assistant", "", "I"),
    ]

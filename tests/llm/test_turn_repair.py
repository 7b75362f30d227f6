"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from trailframe.llm import turn_repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, fault string, pid int, cost double"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def moves(state, role):
    first = role[:1]
    return 1 if first == "s" and state == 0 else 2 if first == "u" and state != 2 else 3 if first == "a" and state == 2 else None


def searched(rows):
    """Dijkstra over (cost, audit), with what the edits give."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    done, heap = set(), [(0, "", 0, 0, None)]
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            lines = []
            while out:
                out, line = out
                lines.append(line)
            return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines[::-1]).encode()).hexdigest()
        if (i, state) in done:
            continue
        done.add((i, state))

        def push(cost, letter, i, role, line, audit=audit, state=state, out=out):
            to = moves(state, role)
            if to is not None:
                heapq.heappush(heap, (cost, audit + letter, i, to, (out, line)))

        for role in ("user", "assistant"):
            push(cost + 3, "I", i, role, f"{role}:")
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if faults[i] not in ("b", "d"):
                extra = 3 * (faults[i] == "t")
                push(cost + extra, "K", i + 1, role, f"{role}:{text}")
                for other in ("user", "assistant"):
                    push(cost + extra + 3, "R", i + 1, other, f"{other}:{text}")


def brute(rows, harmed=True):
    groups = {r[0]: [] for r in rows}
    for conv, *rest in damaged(rows) if harmed else rows:
        groups[conv].append(tuple(rest))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: searched(sorted(v, key=order)) for c, v in groups.items()}


def made(seed, n, conv_of):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", "", None, "Supervisor", "user", "assistant"]
    texts = ["Yes.", "No", "", None, " \n", "a? ", "b!\n", "long. " * 30, "x.y", "é…", "Tell me more.", "z\x00."]
    return [(conv_of(r), r.choice([None, *range(9)]), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"text {r.random()}.") for _ in range(n)]


@pytest.fixture(scope="module")
def odd():
    hot = [(7, t, ("user", "assistant")[t % 2], f"turn {t}" + (".", "")[t % 5 == 0]) for t in range(600)]
    same = [(9, 1, "user", "Same text.")] * 300
    first = [(c, 0, "user", "Hello there.") for c in range(100, 160)]
    return made(1, 400, lambda r: r.choice([None, *range(-3, 6)])) + hot + same + first + [(200, 0, None, None), (201, None, "assistant", "Alone."), (202, 3, "system", "Only."), (203, 5, "user", "w " * 200_000 + ".")]


def frame(spark, rows, n=4):
    return spark.createDataFrame([(*r, "f", 1, 0.5) for r in rows], SCHEMA).repartition(n)


def by_conversation(rows):
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_repair_by_search(spark, odd, tmp_path, partitions):
    """In one partition, and so spread that conversations, and even equal rows, lie in many."""
    frame(spark, odd).write.parquet(str(tmp_path / "conversations.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = turn_repair.op13_turn_repair(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute(odd)
    assert len(found) == len(want) and by_conversation(found) == want


def test_repaired_turns_give_the_hash(spark, odd):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    try:
        rows = turn_repair.damage(frame(spark, odd))
        turns = turn_repair.repaired_turns(rows).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    lines = defaultdict(list)
    for r in sorted(turns, key=lambda r: (r["part"], r["place"])):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, want in brute(odd).items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == want[-1]


def test_no_rows_and_no_rows_left(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "a" / "conversations.parquet"))
    assert turn_repair.op13_turn_repair(spark, str(tmp_path / "a")).collect() == []
    gone = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    frame(spark, [(*gone, "user", "Hi.")]).write.parquet(str(tmp_path / "b" / "conversations.parquet"))
    found = turn_repair.op13_turn_repair(spark, str(tmp_path / "b")).collect()
    assert [tuple(r) for r in found] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_matrices_multiply_in_any_grouping():
    r = random.Random(4)
    for _ in range(60):
        m = [turn_repair._OF[r.choice("xsuaoSUAO")] for _ in range(7)]
        left = m[0]
        for x in m[1:]:
            left = turn_repair.product(left, x)
        right = m[-1]
        for x in m[-2::-1]:
            right = turn_repair.product(x, right)
        assert left == right == turn_repair.reduced(m)


def test_hash_is_taken_up_again():
    h = turn_repair.Sha256()
    data = bytes(range(256)) * 5
    for i in range(0, len(data), 77):
        h = turn_repair.Sha256(h.state())
        h.update(data[i : i + 77])
    assert h.hexdigest() == hashlib.sha256(data).hexdigest()

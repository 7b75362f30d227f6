"""Cheapest repair of conversations by a min-plus scan: each turn is a 4 x 4 matrix over (cost, audit), insertions closed in front of it;
the product of a conversation's matrices has its cheapest edits. The product is associative, so pieces of a conversation are reduced
where they lie, as a tree, and then across partitions.

States: 0 nothing yet, 1 after a leading system turn, 2 after a user, 3 after an assistant; 0 and 3 may end. Elements are compared by
cost, then by audit. That is a semiring here: two audits of equal cost over the same rows are never prefixes of each other, as the
longer one would have more insertions at 3 each, so their order lasts whatever is put before or behind them."""

from __future__ import annotations

import ctypes
import hashlib
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm import common as C
from trailframe.sources.shared import scratch

#: Costs, white space, ends of sentences.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
USER, ASSISTANT = "user", "assistant"
#: Pieces that are multiplied at once where a conversation lies in several partitions.
FAN = 8

Element = tuple[int, str]
Matrix = list[Element | None]


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [None] * 16
    for i in range(0, 16, 4):
        for k in range(4):
            x = a[i + k]
            if x is None:
                continue
            cost, audit = x
            for j in range(4):
                y = b[4 * k + j]
                if y is not None:
                    z, old = cost + y[0], out[i + j]
                    if old is None or z < old[0] or z == old[0] and audit + y[1] < old[1]:
                        out[i + j] = (z, audit + y[1])
    return out


def reduced(matrices: list[Matrix]) -> Matrix:
    """Their product, as a tree, so that audits are copied once a level."""
    while len(matrices) > 1:
        pairs = [product(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0]


def _steps(user: Element | None, assistant: Element | None, system: Element | None = None, stay: Element | None = None) -> Matrix:
    out: Matrix = [None] * 16
    for i in range(4):
        moves = [(1, system)] if i == 0 else []
        moves += [(3, assistant)] if i == 2 else [(2, user)]
        for j, e in [*moves, (i, stay)]:
            if e is not None and (out[4 * i + j] is None or e < out[4 * i + j]):
                out[4 * i + j] = e
    return out


_ONE = _steps((INSERT, "I"), (INSERT, "I"), stay=(0, ""))
#: Any number of insertions: three lead from any state to any other that can be reached.
INSERTIONS = reduced([_ONE] * 3)


def _matrix(kind: str) -> Matrix:
    """Of a turn: `x` must go; else its role's initial (s, u, a, or o for another), in capitals if it is truncated."""
    extra = TRUNCATED if kind.isupper() else 0
    keep, rerole, kind = (extra, "K"), (REROLE + extra, "R"), kind.lower()
    if kind == "x":
        step = _steps(None, None, stay=(DELETE, "D"))
    else:
        step = _steps(keep if kind == "u" else rerole, keep if kind == "a" else rerole, keep if kind == "s" else None, (DELETE, "D"))
    return product(INSERTIONS, step)


_OF = {k: _matrix(k) for k in "xsuaoSUAO"}


def cheapest(turns: Matrix | None) -> Element:
    if turns is None:
        return 0, ""
    end = product(turns, INSERTIONS)
    return min(x for x in (end[0], end[3]) if x is not None)


def applied(audit: str, rows: Iterable[tuple[str, str]], state: int = 0) -> Iterable[tuple[str, str, str]]:
    """edit, role and text of each turn of the repaired conversation, from state 0, 1, 2 or 3 on; deleted turns are left out."""
    rows = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = ASSISTANT if state == 2 else USER
        state = _state(state, role)
        yield edit, role, text


def _state(state: int, role: str) -> int:
    return {"s": 1, "u": 2, "a": 3}[role[:1]]


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32(`conv_id:turn`) % 20; nulls count as one space."""
    space = F.lit(" ")
    text = F.coalesce("text", space)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    code = F.crc32(key.cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(text, STOPS, "")).otherwise(text)
    role = F.when(code == 4, USER).otherwise(F.coalesce("role", space))
    copies = F.explode(F.when(code == 0, F.array().cast("array<int>")).when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("__copy")


def _runs(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault (b, d, t or empty) and pid, the number of the partition, in order: by conversation and turn (nulls
    first), then by role and text, of which equal beginnings of 64 characters are ordered by hash. A conversation may lie in several
    partitions, and even equal rows may. Duplicates of earlier turns are marked here; those of the same turn stand side by side."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("salt"),  # of the input's order, so that a task that runs again deals rows alike
    )
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    blank, stop = bare == "", F.right(bare, F.lit(1)).isin(*STOPS)
    rows = rows.withColumns({"digest": digest, "fault": F.when(blank, "b").when(~stop, "t").otherwise("")})
    at = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    again = rows.where("fault <> 'b'").groupBy("conv_id", "digest").agg(F.min(at).alias("earliest"), F.max(at).alias("latest")).where("earliest < latest")
    again = again.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "earliest")
    rows = rows.join(again, rows.conv_id.eqNullSafe(again.c) & (rows.digest == again.d), "left")
    fault = F.when((F.col("fault") != "b") & (at > F.col("earliest")), "d").otherwise(F.col("fault"))
    order = ["conv_id", "turn", "role", F.left("text", F.lit(64)), "digest"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("conv_id", "turn", "role", "text", "digest", fault.alias("fault"), "salt").repartitionByRange(n, *order, "salt")
    return C.checkpoint(dealt.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault", F.spark_partition_id().alias("pid")))


def _mark(role: str, text: str, turn: int | None) -> bytes:
    return hashlib.sha256(f"{turn}:{len(role)}:{role}{text}".encode()).digest()


class Edges:
    """What the partitions' first and last rows tell: a few values for each partition, held by the driver and sent to the tasks."""

    def __init__(self, runs: DataFrame):
        def ends(batches):
            first = last = None
            for batch in batches:
                if batch.num_rows:
                    row = lambda i, b=batch: [b.column(c)[i].as_py() for c in range(6)]
                    first, last = first or row(0), row(batch.num_rows - 1)
            if first:
                values = [first[5], first[0], last[0], _mark(first[2], first[3], first[1]), _mark(last[2], last[3], last[1])]
                types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["pid", "first", "last", "opens", "closes"])

        found = sorted(runs.mapInArrow(ends, "pid int, first long, last long, opens binary, closes binary").collect())
        #: partitions whose first row repeats the row before it
        self.repeats = {b.pid for a, b in zip(found, found[1:], strict=False) if a.last == b.first and a.closes == b.opens}
        #: the partitions of each conversation that lies in several
        self.parts: dict[int | None, list[int]] = defaultdict(list)
        for a, b in zip(found, found[1:], strict=False):
            if a.last == b.first:
                held = self.parts[b.first]
                held += [b.pid] if held else [a.pid, b.pid]


#: What is known of the rows of a conversation in one partition. The matrix is there where the conversation goes on elsewhere.
_PIECE = (
    "conv_id long, pid int, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, "
    "opens long, closes long, cost long, audit string, sha string, costs array<long>, audits array<string>"
)
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    types = [kinds[x.split()[1]] for x in _PIECE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, types, strict=True)], _NAMES)


def _packed(m: Matrix) -> dict:
    return {"costs": [-1 if x is None else x[0] for x in m], "audits": ["" if x is None else x[1] for x in m]}


def _unpacked(row: dict) -> Matrix:
    return [None if c < 0 else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True)]


def _illegal(a: str, b: str) -> int:
    return a + b not in ("su", "ua", "au")


def _joined(a: dict, b: dict) -> dict:
    """Of two neighbouring pieces, b after a."""
    sums = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated", "illegal", "turns")}
    sums["illegal"] += _illegal(a["last"], b["first"])
    sums["turns"] -= a["closes"] is not None and a["closes"] == b["opens"]
    lows, highs = ([x[k] for x in (a, b) if x[k] is not None] for k in ("low", "high"))
    ends = {"conv_id": a["conv_id"], "pid": a["pid"], "first": a["first"], "last": b["last"], "opens": a["opens"], "closes": b["closes"]}
    return sums | ends | {"low": min(lows, default=None), "high": max(highs, default=None)}


def _by_run(batches, edges: Edges) -> Iterable[tuple[int | None, int, list[tuple[int | None, str, str, str]]]]:
    """conv_id, pid and the rows (turn, role, text, fault) of each conversation in a partition."""
    key, rows, before = None, [], None
    for batch in batches:
        for conv, turn, role, text, fault, pid in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key is None or conv != key[0]:
                if rows:
                    yield *key, rows
                starts = key is None and pid in edges.repeats
                key, rows, before = (conv, pid), [], None
            else:
                starts = False
            if fault != "b" and (starts or before == (turn, role, text)):
                fault = "d"
            before = (turn, role, text)
            rows.append((turn, role, text, fault))
    if rows:
        yield *key, rows


def _kind(role: str, fault: str) -> str:
    if fault in ("b", "d"):
        return "x"
    kind = role[:1] if role[:1] in ("s", "u", "a") and role[:1] else "o"
    return kind.upper() if fault == "t" else kind


def _piece(conv: int | None, pid: int, rows: list) -> dict:
    faults, initials = [r[3] for r in rows], [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    return {
        "conv_id": conv, "pid": pid, "n": len(rows), "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(map(_illegal, initials, initials[1:])), "first": initials[0], "last": initials[-1], "low": min(turns, default=None),
        "high": max(turns, default=None), "turns": len(set(turns)), "opens": rows[0][0], "closes": rows[-1][0],
    }


def _line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode("utf-8", "surrogatepass")


def _pieces(runs: DataFrame, edges: Edges) -> DataFrame:
    """_PIECE for each conversation in each partition."""

    def run(batches):
        out: list[dict] = []
        for conv, pid, rows in _by_run(batches, edges):
            piece = _piece(conv, pid, rows)
            turns = reduced([_OF[_kind(role, fault)] for _, role, _, fault in rows])
            if conv in edges.parts:
                piece |= _packed(turns)
            else:
                cost, audit = cheapest(turns)
                lines = [_line(role, text) for _, role, text in applied(audit, (r[1:3] for r in rows))]
                piece |= {"cost": cost, "audit": audit, "sha": hashlib.sha256(b"\n".join(lines)).hexdigest()}
            out.append(piece)
            if len(out) == 1000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return runs.mapInArrow(run, _PIECE)


def _across(pieces: DataFrame, edges: Edges) -> DataFrame:
    """_PIECE of each conversation in several partitions, from those of its parts: FAN neighbours are joined in each round."""
    span = max(p[-1] for p in edges.parts.values()) + 1

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.drop_columns(["at"]).to_pylist(), key=lambda r: r["pid"])
        whole = rows[0]
        for r in rows[1:]:
            whole = _joined(whole, r)
        turns = reduced([_unpacked(r) for r in rows])
        return pa.Table.from_batches([_batch([whole | _packed(turns)])])

    width = 1
    while width < span:
        width *= FAN
        at = (F.col("pid") / F.lit(width)).cast("int").alias("at")
        pieces = C.checkpoint(pieces.select("*", at).groupBy("conv_id", "at").applyInArrow(join, _PIECE))

    def finish(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["cost"], r["audit"] = cheapest(_unpacked(r))
                r["costs"] = r["audits"] = None
            yield _batch(rows)

    return C.checkpoint(pieces.mapInArrow(finish, _PIECE))


def _cut(audit: str, counts: list[int]) -> list[str]:
    """The audit's parts over so many rows each; insertions belong to what follows them, the last ones to the last part."""
    out, at = [], 0
    for n in counts[:-1]:
        start = at
        while n:
            n -= audit[at] != "I"
            at += 1
        out.append(audit[start:at])
    return [*out, audit[at:]]


def _shares(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """conv_id, pid, round (from 0), audit, kinds, the repaired roles' states before the part: how each part of a conversation in several
    partitions is edited. The rows of a group are the parts of one conversation, one a partition, without its texts."""
    schema = "conv_id long, pid int, round int, audit string"

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(left.to_pylist(), key=lambda r: r["pid"])
        slices = _cut(right.column("audit")[0].as_py(), [r["n"] for r in rows])
        columns = [pa.array([r["conv_id"] for r in rows], pa.int64()), pa.array([r["pid"] for r in rows], pa.int32()), pa.array(range(len(rows)), pa.int32()), pa.array(slices, pa.string())]
        return pa.Table.from_arrays(columns, ["conv_id", "pid", "round", "audit"])

    return parts.select("conv_id", "pid", "n").groupBy("conv_id").cogroup(whole.select("conv_id", "audit").groupBy("conv_id")).applyInArrow(cut, schema)


class Sha256:
    """SHA-256 that can be put down and taken up elsewhere: the state of the library that hashlib itself uses, as bytes."""

    def __init__(self, state: bytes | None = None):
        import _hashlib

        self.lib = ctypes.CDLL(_hashlib.__file__)
        self.context = ctypes.create_string_buffer(state, 112) if state else ctypes.create_string_buffer(112)
        if not state:
            self.lib.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.context, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, ctypes.create_string_buffer(self.context.raw, 112))
        return out.raw.hex()


def _repaired_parts(runs: DataFrame, edges: Edges, shares: DataFrame) -> DataFrame:
    """conv_id, round, and the repaired turns of the part: edits, roles and texts. Roles that depend on what stood before the part are left
    open (None) where the part's own kept roles don't tell them: it is filled in from the state that comes with the chain."""
    own = set(edges.parts)

    def wanted(batches):
        for conv, pid, rows in _by_run(batches, edges):
            if conv in own:
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([pid], pa.int32()), pa.array([[r[1] for r in rows]], pa.list_(pa.string())), pa.array([[r[2] for r in rows]], pa.list_(pa.string()))], ["conv_id", "pid", "roles", "texts"])

    parts = runs.mapInArrow(wanted, "conv_id long, pid int, roles array<string>, texts array<string>")
    parts = parts.withColumnRenamed("conv_id", "c").withColumnRenamed("pid", "p")
    return shares.join(parts, shares.conv_id.eqNullSafe(parts.c) & (shares.pid == parts.p)).drop("c", "p")


_CHAIN = "conv_id long, state int, sha binary, hex string"


def _chained(parts: DataFrame, rounds: int) -> DataFrame:
    """conv_id and sha: the hashes of conversations that lie in several partitions. A hash goes through its bytes in order, so its state is
    handed from part to part: round r reads the r-th part of every conversation, where it lies in the shared folder. A state of some 150
    bytes for each such conversation, fewer than there are partitions, goes through the driver."""
    spark = parts.sparkSession
    known: dict[int | None, tuple[int, bytes | None]] = {}
    with scratch(spark) as folder:
        parts.write.partitionBy("round").parquet(folder)
        for r in range(rounds):

            def step(batches, known=known):
                for batch in batches:
                    for row in batch.to_pylist():
                        state, held = known.get(row["conv_id"], (0, None))
                        h = Sha256(held)
                        fresh = held is None
                        for _, role, text in applied(row["audit"], zip(row["roles"], row["texts"], strict=True), state):
                            h.update((b"" if fresh else b"\n") + _line(role, text))
                            fresh, state = False, _state(state, role)
                        new = None if fresh else h.state()
                        columns = [[row["conv_id"]], [state], [new], [h.hexdigest()]]
                        types = [pa.int64(), pa.int32(), pa.binary(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "state", "sha", "hex"])

            found = spark.read.parquet(f"{folder}/round={r}").select("conv_id", "audit", "roles", "texts").mapInArrow(step, _CHAIN).collect()
            known = known | {x["conv_id"]: (x["state"], bytes(x["sha"]) if x["sha"] is not None else None) for x in found}
    hexes = [(c, Sha256(s).hexdigest()) for c, (_, s) in known.items()]
    return spark.createDataFrame(hexes, "conv_id long, sha string")


def _edited(rows: DataFrame) -> tuple[DataFrame, Edges, DataFrame, DataFrame, DataFrame | None]:
    runs = _runs(rows)
    edges = Edges(runs)
    pieces = C.checkpoint(_pieces(runs, edges))
    whole = pieces.where("audit is not null")
    parts = pieces.where("audit is null")
    return runs, edges, whole, parts, _across(parts, edges) if edges.parts else None


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of the rows (conv_id, turn,
    role, text; other columns are not read, null roles and texts count as one space, null ids are one conversation).

    Turns are ordered by number, nulls first; turns of one number by role and text. Rows are shuffled once by ranges, so a conversation of
    any length is spread over partitions; what meets in a task of a conversation is its parts' matrices, FAN at a time, and its audit.
    Texts are held while their conversation's part of one partition is read. No rows: no rows."""
    runs, edges, whole, parts, across = _edited(rows)
    found = whole
    if across is not None:
        hashes = _chained(_repaired_parts(runs, edges, _shares(parts, across)), max(map(len, edges.parts.values())))
        hashes = hashes.select(F.col("conv_id").alias("c"), F.col("sha").alias("h"))
        joined = across.join(F.broadcast(hashes), across.conv_id.eqNullSafe(hashes.c))  # fewer than there are partitions
        found = found.unionByName(joined.withColumn("sha", F.col("h")).drop("c", "h"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return found.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


_TURNS = "conv_id long, part int, place long, edit string, role string, text string"


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, part and place (their order), edit (K, R or I), role, text of every turn."""
    runs, edges, _, parts, across = _edited(rows)

    def turns(conv, part, audit, rows, state=0):
        out = list(applied(audit, rows, state))
        columns = [[conv] * len(out), [part] * len(out), list(range(len(out))), *map(list, zip(*out, strict=True))] if out else [[]] * 6
        types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _TURNS.split(", ")])

    def inside(batches):
        for conv, _, rows in _by_run(batches, edges):
            if conv not in edges.parts:
                _, audit = cheapest(reduced([_OF[_kind(role, fault)] for _, role, _, fault in rows]))
                yield turns(conv, 0, audit, [r[1:3] for r in rows])

    out = runs.mapInArrow(inside, _TURNS)
    if across is None:
        return out
    shares = _with_states(_repaired_parts(runs, edges, _shares(parts, across)))

    def spread(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield turns(r["conv_id"], r["round"], r["audit"], list(zip(r["roles"], r["texts"], strict=True)), r["state"])

    return out.unionByName(shares.mapInArrow(spread, _TURNS))


def _with_states(parts: DataFrame) -> DataFrame:
    """The parts with the state that each begins in, from the edits and roles alone."""

    def states(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["round"])
        found, state = [], 0
        for r in rows:
            found.append(state)
            for _, role, _ in applied(r["audit"], [(x, "") for x in r["initials"]], state):
                state = _state(state, role)
        columns = [pa.array([r["conv_id"] for r in rows], pa.int64()), pa.array([r["round"] for r in rows], pa.int32()), pa.array(found, pa.int32())]
        return pa.Table.from_arrays(columns, ["c", "at", "state"])

    initials = parts.select("conv_id", "round", "audit", F.transform("roles", lambda x: F.left(x, F.lit(1))).alias("initials"))
    found = initials.groupBy("conv_id").applyInArrow(states, "c long, at int, state int")
    return parts.join(found, parts.conv_id.eqNullSafe(found.c) & (parts["round"] == found["at"])).drop("c", "at")


def _zero(name: str, value: Column) -> Column:
    return F.coalesce(F.col(name), value).alias(name)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults and cheapest repair after damage; zeros and an empty hash where no row is left."""
    rows = C.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damage(rows)).withColumnRenamed("conv_id", "c")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    every = every.join(found, every.conv_id.eqNullSafe(found.c), "left")
    counts = [_zero(n, F.lit(0).cast("long")) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, _zero("audit", F.lit("")), _zero("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))

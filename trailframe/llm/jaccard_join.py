"""Exact n-gram Jaccard join: signature trees over blocks of documents that share a rare shingle.

A document is the set of its distinct 5-word shingles. Sets of similarity 0.8 share k of the first n - ceil(0.8 n) + k shingles of
both, in any order that all documents use; the order here puts frequent shingles last (by a count-min sketch of fixed size, which may
err without harm), and k is 8 + n / 20. Equal sets are joined once. Then
1. shingles of those prefixes meet, packed, in buckets; those that only one set has go, and sets of incompatible size; sets with
   fewer than the k shared shingles that a partner would need go too;
2. each set goes whole to its first two and its rarest shared shingles ("home"); a shingle of more than BLOCK sets is split by a hash of
   set and shingle, so that a group of near copies meets in other parts at each of its homes. There a signature tree - leaves are bitmaps of the set,
   nodes the OR of their children's bitmaps and the range of sizes - is traversed against itself; a pair of nodes is left out when
   its sizes or the largest possible overlap rule a link out, or when all of it is linked already. Leaves are compared exactly;
3. shared shingles whose sets are still not all in one component - for each set all but its most frequent, of which a partner shares
   rarer ones too - are joined the same way by bitmaps alone; pairs that met at home are left out, and those that meet at an earlier
   one of the CARRIED first such shingles of both; what remains is compared exactly.
Null or empty texts and texts without words have an empty set, and stand alone. Rows with one text have one component; a null id is
never a component's name unless all ids in it are null. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm import common as C
from trailframe.llm.components import components, merged

WIDTH = 5
SKETCH_BITS = 21
FAN = 8
#: Sets that meet whole in one block, on average at most.
BLOCK = 1024
CARRIED = 16


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    h, counts = C.word_hashes(texts)
    out, at = [], 0
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(0x9FB21C651E98DF25) + h[k : k + len(rolled)]
        rolled = C.mix(rolled)
        for n in counts.tolist():
            if n >= width:
                out.append(np.unique(rolled[at : at + n - width + 1]))
            elif n:
                x = np.zeros(1, np.uint64)
                for k in range(n):
                    x = x * np.uint64(0x9FB21C651E98DF25) + h[at + k]
                out.append(C.mix(x + np.uint64(n) * np.uint64(0x8CB92BA72F3D8DD7)))
            else:
                out.append(np.empty(0, np.uint64))
            at += n
    return out


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _common_at_least(n: int) -> int:
    return (4 * n + 4) // 5


def _wanted(n: int) -> int:
    """How many shingles the prefixes of similar sets have in common, if the smaller has n."""
    return min(8 + n // 20, _common_at_least(n))


def _prefix(n: int) -> int:
    return n - _common_at_least(n) + _wanted(n)


def _sketch(batches):
    """Counts of the smallest hashes of each set: its prefix, and a twentieth of the set more, for what follows frequent shingles."""
    total = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in batches:
        for _, texts in C.text_chunks(batch):
            for s in shingle_sets(texts):
                total[(s[: _prefix(len(s)) + len(s) // 20] & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)] += 1
    size = 1 << 17
    for i in range(0, len(total), size):
        if total[i : i + size].any():
            yield pa.RecordBatch.from_arrays([pa.array([i // size], pa.int32()), pa.array([zlib.compress(np.minimum(total[i : i + size], 65535).astype(np.uint16).tobytes(), 1)], pa.binary())], ["part", "counts"])


def _summed(table: pa.Table) -> pa.Table:
    """The parts of the sketch with a bit for each frequent counter: twice the mean and 32 more."""
    total = sum(np.frombuffer(zlib.decompress(x), np.uint16).astype(np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.packbits(total > 2 * total.mean() + 32).tobytes()], pa.binary())})


def _frequent(docs: DataFrame) -> np.ndarray:
    """2^21 bits reach the driver, whatever the input."""
    out = np.zeros(1 << SKETCH_BITS, bool)
    for r in docs.mapInArrow(_sketch, "part int, counts binary").groupBy("part").applyInArrow(_summed, "part int, bits binary").collect():
        out[r["part"] << 17 : (r["part"] + 1) << 17] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8)).astype(bool)
    return np.packbits(out)


def _in_order(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    bit = (s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)
    late = (frequent[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
    return np.concatenate([s[late == 0], s[late == 1]])


def _first_pass(frequent: np.ndarray, n: int):
    """Rows of two kinds: bucket -1 with (rid, doc_id, size, set id); and packed prefixes by bucket."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            rids = dict(zip(("rid", "key"), (batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()), strict=True))
            at = 0
            for ids, texts in C.text_chunks(batch):
                sets = shingle_sets(texts)
                tokens, owner, sizes = [], [], []
                names = [_set_id(s) if len(s) else None for s in sets]
                for s, name in zip(sets, names, strict=True):
                    if name is None or name in seen:
                        continue
                    if len(seen) < 2_000_000:
                        seen.add(name)
                    p = _in_order(s, frequent)[: _prefix(len(s))]
                    tokens.append((p >> np.uint64(32)).astype(np.uint32))
                    owner.append(np.full(len(p), name, np.int64))
                    sizes.append(np.full(len(p), len(s), np.uint32))
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1] * k, pa.int32()), pa.array(rids["rid"][at : at + k], pa.int64()), pa.array(rids["key"][at : at + k], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), *(pa.nulls(k, pa.binary()) for _ in range(3))],
                    ["bucket", "doc_id", "rid", "n", "sid", "tokens", "sids", "sizes"],
                )
                at += k
                if tokens:
                    t = np.concatenate(tokens)
                    b = C.packed((t % np.uint32(n)).astype(np.int64), [t, np.concatenate(owner), np.concatenate(sizes)], ["tokens", "sids", "sizes"])
                    k = b.num_rows
                    yield pa.RecordBatch.from_arrays([b.column(0), *(pa.nulls(k, pa.int64()) for _ in range(4)), *(b.column(i) for i in (1, 2, 3))], ["bucket", "doc_id", "rid", "n", "sid", "tokens", "sids", "sizes"])

    return run


FIRST = "bucket int, doc_id long, rid long, n long, sid long, tokens binary, sids binary, sizes binary"


def _shared(table: pa.Table) -> pa.Table:
    """(token, set) where another set of compatible size has the token too, with the number of sets that have it."""
    t, s, n = C.unpacked(table, "tokens", np.uint32), C.unpacked(table, "sids", np.int64), C.unpacked(table, "sizes", np.uint32).astype(np.int64)
    order = np.lexsort((s, n, t))
    t, s, n = t[order], s[order], n[order]
    new = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])] if len(t) else np.empty(0, bool)
    t, s, n = t[new], s[new], n[new]
    near = (t[1:] == t[:-1]) & (5 * n[:-1] >= 4 * n[1:])
    keep = np.r_[near, False] | np.r_[False, near] if len(t) else np.empty(0, bool)
    t, s, n = t[keep], s[keep], n[keep]
    _, inverse, count = np.unique(t, return_inverse=True, return_counts=True)
    return pa.table({"token": pa.array(t.astype(np.int64)), "sid": pa.array(s), "n": pa.array(n), "df": pa.array(count[inverse].astype(np.int64) if len(t) else np.empty(0, np.int64))})


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits of a set's hashes; the length is a power of two from twice to four times the size."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(s >> np.uint64(8)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(out).view(np.uint64)


def _fold(b: np.ndarray, length: int) -> np.ndarray:
    while len(b) > length:
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return b


class SignatureTree:
    """Leaves by size; each level has a node for FAN of the level below: OR of bitmaps, range of sizes, and the most tokens of a leaf
    that its bitmap doesn't show apart (size less bits set)."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[np.ndarray]):
        length = min(len(b) for b in bitmaps)
        bits = np.stack([_fold(b, length) for b in bitmaps])
        spare = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, spare)]
        while len(self.levels[-1][0]) > 1:
            bits, least, most, spare = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(spare, at)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether leaves below nodes i and j can have 80 % in common: overlap is at least 4/9 of the sum of sizes then."""
        bits, least, most, spare = self.levels[level]
        need = 4 * (least[i] + least[j])
        ok = (5 * most[i] >= 4 * least[j]) & (5 * most[j] >= 4 * least[i])
        ok[ok] = 9 * np.minimum(most[i[ok]], most[j[ok]]) >= need[ok]
        i, j = i[ok], j[ok]
        overlap = np.bitwise_count(bits[i] & bits[j]).sum(axis=1).astype(np.int64) + np.minimum(spare[i], spare[j])
        ok[ok] = 9 * overlap >= need[ok]
        return ok

    def pairs(self, label: np.ndarray, visit) -> None:
        """Dual traversal of the tree against itself, inner pairs first. visit(i, j) may change `label`; nodes whose leaves all have
        one label are left out."""
        n = len(self.levels[0][0])
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            span = FAN**level
            x = label[i * span : min(n, (i + 1) * span)]
            y = label[j * span : min(n, (j + 1) * span)]
            if x[0] == y[0] and (x == x[0]).all() and (y == y[0]).all() and (i != j or len(x) == 1 or level > 0):
                continue
            if level == 0:
                if i != j:
                    visit(i, j)
                continue
            width = len(self.levels[level - 1][0])
            a = np.arange(i * FAN, min(width, (i + 1) * FAN))
            b = np.arange(j * FAN, min(width, (j + 1) * FAN))
            if i == j:
                p, q = np.triu_indices(len(a), 1)
                p, q = a[p], a[q]
            else:
                p, q = np.repeat(a, len(b)), np.tile(b, len(a))
            if level == 1:
                apart = label[p] != label[q]
                p, q = p[apart], q[apart]
            ok = self.possible(level - 1, p, q) if len(p) else np.zeros(0, bool)
            stack.extend((level - 1, int(u), int(v)) for u, v in zip(p[ok][::-1], q[ok][::-1], strict=True))
            if i == j and level > 1:  # on top: these come first
                stack.extend((level - 1, int(u), int(u)) for u in a[::-1])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def link_block(sids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all sets of a block which similarities connect: from each to the smallest name among them."""
    order = np.array(sorted(range(len(sids)), key=lambda k: (len(sets[k]), sets[k][0], sids[k])))
    sids, sets = sids[order], [sets[k] for k in order]
    label = np.arange(len(sids))
    members = {k: [k] for k in range(len(sids))}

    def visit(i: int, j: int) -> None:
        if label[i] != label[j] and similar(sets[i], sets[j]):
            a, b = sorted((int(label[i]), int(label[j])), key=lambda x: -len(members[x]))
            label[members[b]] = a  # the smaller part is renamed
            members[a] += members.pop(b)

    if len(sids) == 2:
        visit(0, 1)
    else:
        SignatureTree(np.array([len(s) for s in sets], np.int64), [bitmap(s) for s in sets]).pairs(label, visit)
    least = np.full(len(sids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, sids)
    return [(int(a), int(b)) for a, b in zip(sids, least[label], strict=True) if a != b]


def _blocks(table: pa.Table):
    """(rows of one token, a row for each set) in turn."""
    token = table.column("token").to_numpy()
    sid = table.column("sid").to_numpy()
    order = np.lexsort((sid, token))
    token, sid = token[order], sid[order]
    new = np.r_[True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])] if len(token) else np.empty(0, bool)
    order, token = order[new], token[new]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
    for s, e in zip(starts, np.r_[starts[1:], len(token)], strict=True):
        if e - s > 1:
            yield order[s:e]


def _links_table(links: set[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _home_links(table: pa.Table) -> pa.Table:
    sid, column = table.column("sid").to_numpy(), table.column("items").combine_chunks()
    links: set[tuple[int, int]] = set()
    for rows in _blocks(table):
        links.update(link_block(sid[rows], [np.frombuffer(column[int(i)].as_py(), np.uint64) for i in rows]))
    return _links_table(links)


def _by_label(rows: np.ndarray, n: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows of one label side by side, in the order of each label's smallest size, so that nodes of the tree have few labels."""
    _, of = np.unique(label[rows], return_inverse=True)
    least = np.full(of.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, of, n[rows])
    return rows[np.lexsort((n[rows], of, least[of]))]


def _open_pairs(table: pa.Table) -> pa.Table:
    """Pairs of a block that have different labels, have not met at home, and whose bitmaps allow a link."""
    sid, n, label, token = (table.column(c).to_numpy() for c in ("sid", "n", "label", "token"))
    first = [set(x) for x in table.column("carried").to_pylist()]
    home = [set(x) for x in table.column("home").to_pylist()]
    bits = table.column("bits").combine_chunks()
    out: set[tuple[int, int]] = set()
    for rows in _blocks(table):
        rows = _by_label(rows, n, label) if len(rows) > 2 else rows
        own = label[rows]

        def visit(i: int, j: int, rows=rows, own=own, at=int(token[rows[0]])) -> None:
            x, y = rows[i], rows[j]
            if own[i] != own[j] and not home[x] & home[y] and min(first[x] & first[y], default=at) >= at:
                out.add((int(min(sid[x], sid[y])), int(max(sid[x], sid[y]))))

        if len(rows) > 2 or (own[0] != own[1] and not home[rows[0]] & home[rows[1]]):
            SignatureTree(n[rows], [np.frombuffer(bits[int(i)].as_py(), np.uint64) for i in rows]).pairs(own, visit)
    return _links_table(out)


def _verified(batches):
    for batch in batches:
        keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches):
    for batch in batches:
        for sids, texts in C.text_chunks(batch, name="sid"):
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())], ["sid", "n", "items", "bits"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    spark = docs.sparkSession
    n = C.bucket_count(spark)
    docs = C.id_and_text(docs, id_col, text_col).withColumn("key", F.xxhash64("doc_id", "text"))
    first = C.checkpoint(docs.mapInArrow(_first_pass(_frequent(docs.select("doc_id", "text")), n), FIRST).where("bucket >= 0 or rid is not null"))
    members = first.where("bucket < 0").select("doc_id", "rid", "n", "sid")
    shared = C.checkpoint(first.where("bucket >= 0").select("bucket", "tokens", "sids", "sizes").groupBy("bucket").applyInArrow(_shared, "token long, sid long, n long, df long"))
    for _ in range(2):  # a set can have partners only among sets that can have partners
        least = F.expr("(4 * n + 4) div 5")
        enough = shared.groupBy("sid").agg(F.count("*").alias("found"), F.min("n").alias("n")).withColumn("n", least)
        enough = enough.where(F.col("found") >= F.least(8 + F.expr("n div 20"), least)).select("sid")
        shared = shared.join(enough, "sid", "left_semi")
        alone = shared.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        shared = C.checkpoint(shared.drop("df").join(alone, "token"))

    part = F.pmod(F.xxhash64("sid", "token"), F.ceil(F.col("df") / BLOCK))
    at = shared.withColumn("at", F.struct("token", (F.shiftleft(part, 32) + F.col("token")).alias("block")))
    first_two, rarest = F.slice(F.array_sort(F.collect_list("at")), 1, 2), F.array(F.min_by("at", F.struct("df", "token")))
    home = at.groupBy("sid").agg(F.array_distinct(F.transform(F.concat(first_two, rarest), lambda x: x["block"])).alias("home"))
    keys = members.where("sid is not null").groupBy("sid").agg(F.min("rid").alias("rid")).join(home, "sid")
    keys = C.checkpoint(keys)
    flags = C.marked(_with_bit(keys.select("rid")))

    def candidates(batches):
        for batch in batches:
            yield batch.filter(pa.array(C.is_marked(flags, np.array(batch.column("key").to_pylist(), np.int64))))

    texts = docs.mapInArrow(candidates, docs.schema).join(keys, F.col("key") == keys.rid).select("sid", "text")
    sets = C.checkpoint(texts.mapInArrow(_sets, "sid long, n long, items binary, bits binary").dropDuplicates(["sid"]))
    at_home = sets.select("sid", "items").join(keys.select("sid", F.explode("home").alias("token")), "sid")
    bucket = F.pmod(F.xxhash64("token"), F.lit(n)).alias("bucket")
    links = C.checkpoint(at_home.groupBy(bucket).applyInArrow(_home_links, "a long, b long"))
    labels = components(links)

    named = shared.join(labels, shared.sid == labels.node, "left").select("token", "sid", "n", "df", F.coalesce("label", "sid").alias("label"))
    open_ = C.checkpoint(_mixed(_rarest(C.checkpoint(_mixed(named))), once=True))
    carried = open_.groupBy("sid").agg(F.slice(F.array_sort(F.collect_list("token")), 1, CARRIED).alias("carried"))
    rest = open_.join(carried, "sid").join(sets.select("sid", "n", "bits"), "sid").join(keys.select("sid", "home"), "sid")
    pairs = rest.groupBy(bucket).applyInArrow(_open_pairs, "a long, b long").distinct()
    x = sets.select(F.col("sid").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("sid").alias("b"), F.col("items").alias("y"))
    more = C.checkpoint(pairs.join(x, "a").join(y, "b").mapInArrow(_verified, "a long, b long"))
    if not more.isEmpty():
        labels = merged(labels, more)

    of = members.join(labels, members.sid == labels.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "sid").alias("label"))
    least = of.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    joined = of.where("label is not null").join(least, "label").select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(of.where("label is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _mixed(named: DataFrame, once: bool = False) -> DataFrame:
    """Rows of the tokens whose sets have more than one label; with `once`, of tokens that the very same sets have, one alone."""
    same = [F.bit_xor(F.xxhash64("sid", F.lit(k))).alias(f"same{k}") for k in range(2)] if once else []
    tokens = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("sets"), *same).where("low <> high")
    if once:
        tokens = tokens.groupBy("same0", "same1", "low", "high", "sets").agg(F.min("token").alias("token"))
    return named.join(tokens.select("token"), "token")


def _rarest(named: DataFrame) -> DataFrame:
    """The rows in which every link between two labels is still met. A partner of a set of n has 0.8 n shingles at least, so the two have
    k = wanted(0.8 n) of these tokens in common at least, and all but the k - 1 that come last in one order (here: by number of sets)
    hold the first common one. A set with fewer than k tokens has no partner."""
    k = F.least(8 + F.expr("((4 * n + 4) div 5) div 20"), F.expr("(4 * ((4 * n + 4) div 5) + 4) div 5"))
    own = Window.partitionBy("sid")
    placed = named.withColumn("place", F.row_number().over(own.orderBy("df", "token"))).withColumn("found", F.count("*").over(own))
    return placed.where(F.col("place") <= F.col("found") - k + 1).drop("place", "found", "n", "df")


def _with_bit(rids: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(C.bit_hash(np.array(batch.column("rid").to_pylist(), np.int64)), pa.int64())], ["bit"])

    return rids.mapInArrow(run, "bit long")


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(C.read(spark, sf_dir, "documents"))

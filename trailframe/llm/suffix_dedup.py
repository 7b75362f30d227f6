"""Removal of long repeated strings, by the common-prefix interval tree of an enhanced suffix array.

A string of MIN_LENGTH bytes that starts at two places has the same smallest 64-byte gram (by hash, leftmost of equal ones) at
both, so only suffixes that start at such grams ("anchors", about one in 70 bytes) need sorting. Suffixes with equal grams meet in
one bucket. There they are sorted with the lengths of common prefixes, and one scan with a stack gives the interval tree: each node
is a set of suffixes that agree for `depth` bytes and then differ. Within a node the members are sorted by what stands left of the
anchor; members that agree for l bytes there and differ beyond (left diversity) and come from two children of the node (right
diversity) are all occurrences of one maximal repeat of l + depth bytes.

To remove bytes, surroundings of MIN_LENGTH bytes suffice. Groups of repeats look REACH bytes to both sides of an anchor: every maximal
repeat of up to REACH bytes is given once, by its first anchor, with all its places. A repeat that goes on to the left beyond REACH is
given in overlapping pieces, one for each further anchor, and one that goes on to the right is cut there.

Hot strings stay spread out. Of equal surroundings in a chunk of texts two are sent on, since the others are known to repeat; so a bucket
gets two from each chunk, however many texts hold them. Surroundings that differ though their gram stands at more than HOT places (where a
very common passage begins or ends) can't meet in one sorted bucket: for these, each string of MIN_LENGTH bytes over the anchor is a key of
its own (a hash of 128 bits), and the strings are dealt over all tasks. Both ways find the same bytes. Groups of repeats don't use this.

Rows are told apart by a hash of id and text, so null ids, repeated ids and repeated rows are allowed; a repeated row counts as
another place. Null and empty texts, and texts shorter than MIN_LENGTH, lose nothing. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm import common as C

MIN_LENGTH, GRAM, REACH = 200, 64, 4096
#: Places of a gram beyond which no bucket holds all of its surroundings: some 45 MB of them.
HOT = 1 << 17
SEGMENT = 1 << 19
_B = 0x9E3779B97F4A7C15 | 1
_TABLE = C.mix(np.arange(1, 257, dtype=np.uint64))
_SECOND = C.mix(np.arange(1001, 1257, dtype=np.uint64))


class Frame(NamedTuple):
    """What is looked for, and how far around an anchor."""

    length: int
    left: int
    right: int

    @property
    def width(self) -> int:
        """Bytes of a row: the key, what stands left (from the anchor on) and right of the anchor, and how long both are."""
        return 8 + self.left + self.right + 4


def narrow(length: int) -> Frame:
    return Frame(length, length - GRAM, length)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if n not in _POWERS:
        out = []
        for base in (_B, pow(_B, -1, 1 << 64)):
            p = np.ones(n, np.uint64)
            p[1:] = np.uint64(base)
            out.append(np.multiply.accumulate(p))
        _POWERS[n] = tuple(out)
    return _POWERS[n]


def _ranks(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """How many elements equal to it (in all arrays) stand before each."""
    order = np.lexsort((*more, x))
    new = np.ones(len(x), bool)
    new[1:] = np.any([v[order][1:] != v[order][:-1] for v in (x, *more)], axis=0)
    starts = np.flatnonzero(new)
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
    return out


def _segment_anchors(buf: np.ndarray, starts: list[int], ends: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a buffer of at most 2^20 bytes that holds whole pieces [start, end): offsets, and hashes of their grams."""
    n, w = len(buf), length - GRAM + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    pw, inv = _powers(1 << 20)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[buf] * pw[:n], out=sums[1:])
    h = C.mix((sums[GRAM:] - sums[:-GRAM]) * inv[: n - GRAM + 1])
    m = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < w:
        m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
    valid = np.zeros(len(m), bool)
    for s, e in zip(starts, ends, strict=True):
        if e - s >= length:
            valid[s : e - length + 1] = True
    at = np.unique((m[valid] & np.uint64((1 << 20) - 1)).astype(np.int64))
    return at, h[at]


def anchors(texts: list[bytes], length: int = MIN_LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the text, offsets of its anchors, hashes of their grams) for texts of `length` bytes at least."""
    pending, total = [], 0

    def flush():
        buf = np.frombuffer(b"".join(t for _, t in pending), np.uint8)
        ends = np.cumsum([len(t) for _, t in pending]).tolist()
        starts = [0, *ends[:-1]]
        at, h = _segment_anchors(buf, starts, ends, length)
        cut = np.searchsorted(at, [*starts, len(buf)])
        for (i, _), s, lo, hi in zip(pending, starts, cut[:-1], cut[1:], strict=True):
            if hi > lo:
                yield i, at[lo:hi] - s, h[lo:hi]

    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > SEGMENT:  # pieces that overlap, so that each string of `length` bytes is whole in one
            found = []
            for s in range(0, len(t) - length + 1, SEGMENT):
                piece = t[s : s + SEGMENT + length - 1]
                at, h = _segment_anchors(np.frombuffer(piece, np.uint8), [0], [len(piece)], length)
                found.append((at + s, h))
            at, first = np.unique(np.concatenate([a for a, _ in found]), return_index=True)
            yield i, at, np.concatenate([h for _, h in found])[first]
            continue
        if total + len(t) > SEGMENT:
            yield from flush()
            pending, total = [], 0
        pending.append((i, t))
        total += len(t)
    if pending:
        yield from flush()


def _rows(text: bytes, at: np.ndarray, keys: np.ndarray, frame: Frame) -> np.ndarray:
    """What stands around each anchor, as rows of bytes."""
    reach = frame.left
    start = max(0, int(at.min()) - reach) if len(at) else 0
    end = min(len(text), int(at.max()) + frame.right) if len(at) else 0
    buf = np.frombuffer(b"\0" * reach + text[start:end] + b"\0" * frame.right, np.uint8)
    rows = np.empty((len(at), frame.width), np.uint8)
    rows[:, :8] = keys.astype(">u8").view(np.uint8).reshape(-1, 8)
    # the zeros in front stand for what is before `start`, of which no anchor sees any
    windows = np.lib.stride_tricks.sliding_window_view(buf, reach + frame.right)[at - start]
    rows[:, 8 : 8 + reach] = windows[:, :reach][:, ::-1]
    rows[:, 8 + reach : -4] = windows[:, reach:]
    rows[:, -4:-2] = np.minimum(at, reach).astype(">u2").view(np.uint8).reshape(-1, 2)
    rows[:, -2:] = np.minimum(len(text) - at, frame.right).astype(">u2").view(np.uint8).reshape(-1, 2)
    return rows


def contexts(text: bytes, at: np.ndarray, keys: np.ndarray, frame: Frame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of anchors, equal ones once; the first anchor of each, how many anchors it has, and the row of every anchor."""
    rows = _rows(text, at, keys, frame)
    flat = np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel()
    seen: dict[bytes, int] = {}
    of = np.array([seen.setdefault(x.tobytes(), len(seen)) for x in flat], np.int64)
    first = np.full(len(seen), len(at), np.int64)
    np.minimum.at(first, of, np.arange(len(at)))
    return rows[first], first, np.bincount(of, minlength=len(seen)), of


def same_contexts(text: bytes, at: np.ndarray, frame: Frame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As contexts, by hashes of what stands around, without the rows: the first anchor of each, how many it has, the one of every anchor,
    and its hash."""
    h = np.empty(len(at), np.uint64)
    pw, inv = _powers(1 << 20)
    for s in range(0, len(text), SEGMENT):
        inside = np.flatnonzero((at >= s) & (at < s + SEGMENT))
        if not len(inside):
            continue
        low = max(0, s - frame.left)
        buf = np.frombuffer(text[low : s + SEGMENT + frame.right], np.uint8)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * pw[: len(buf)], out=sums[1:])
        here = at[inside]
        a, e = np.maximum(here - frame.left, 0), np.minimum(here + frame.right, len(text))
        sizes = ((here - a) * (1 << 20) + (e - here)).astype(np.uint64)
        h[inside] = C.mix((sums[e - low] - sums[a - low]) * inv[a - low] + C.mix(sizes + np.uint64(1)))
    h, first, of, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    return first, count, of, h


def windows(text: bytes, at: np.ndarray, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each string of `length` bytes over each anchor's gram, with the anchor's key and place in it; the anchor of each string
    (an index of `at`), and how many bytes of it stand left of the anchor."""
    low = np.maximum(at - (length - GRAM), 0)
    n = np.minimum(at, len(text) - length) - low + 1
    of = np.repeat(np.arange(len(at)), n)
    start = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    left = at[of] - start
    out = [np.empty(len(of), np.uint64) for _ in range(2)]
    pw, inv = _powers(1 << 20)
    for s in range(0, len(text), SEGMENT):
        inside = np.flatnonzero((start >= s) & (start < s + SEGMENT))
        if not len(inside):
            continue
        buf = np.frombuffer(text[s : s + SEGMENT + length], np.uint8)
        a = start[inside] - s
        for table, h in zip((_TABLE, _SECOND), out, strict=True):
            sums = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(table[buf] * pw[: len(buf)], out=sums[1:])
            h[inside] = C.mix((sums[a + length] - sums[a]) * inv[a] + C.mix(keys[of[inside]] + left[inside].astype(np.uint64)))
    return out[0], out[1], of, left


def interval_tree(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(depth, first, last) of every interval of a suffix array whose members share `depth` > 0 symbols and no larger set does;
    lcp[i] is that of members i and i + 1."""
    stack: list[list[int]] = []
    out = []
    for i, x in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > x:
            depth, first = stack.pop()
            out.append((depth, first, i))
        if x > 0 and (not stack or stack[-1][0] < x):
            stack.append([x, first])
    return out


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows of a and b, `most` at most."""
    if not len(a):
        return np.empty(0, np.int64)
    differ = a != b
    return np.where(differ.any(axis=1), np.minimum(differ.argmax(axis=1), most), most).astype(np.int64)


def scan(rows: np.ndarray, frame: Frame, groups: bool = False):
    """Covered bytes (left, right) around each row's anchor; with `groups`, the maximal repeats as (left, depth, members) too."""
    length, reach, n = frame.length, frame.left, len(rows)
    order = np.argsort(np.ascontiguousarray(np.concatenate([rows[:, :8], rows[:, 8 + reach : -4]], axis=1)).view(f"S{8 + frame.right}").ravel(), kind="stable")
    rows = rows[order]
    key = np.ascontiguousarray(rows[:, :8]).view(">u8").ravel()
    left, right = rows[:, 8 : 8 + reach], rows[:, 8 + reach : -4]
    n_left, n_right = (np.ascontiguousarray(rows[:, x : x + 2 or None]).view(">u2").ravel().astype(np.int64) for x in (-4, -2))
    cover = np.zeros((n, 2), np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], n]
    repeats = []
    lcp = np.empty(max(0, n - 1), np.int64)
    step = max(1, (1 << 22) // frame.right)
    for s in range(0, n - 1, step):
        e = min(s + step, n - 1)
        lcp[s:e] = _common(right[s:e], right[s + 1 : e + 1], np.minimum(n_right[s:e], n_right[s + 1 : e + 1]))
    pair = starts[ends - starts == 2]
    if len(pair):  # a node of two leaves
        l = _common(left[pair], left[pair + 1], np.minimum(n_left[pair], n_left[pair + 1]))
        ok = l + lcp[pair] >= length
        for at in (pair[ok], pair[ok] + 1):
            cover[at, 0], cover[at, 1] = l[ok], lcp[pair[ok]]
        if groups:
            repeats += [(int(x), int(lcp[p]), order[[p, p + 1]]) for p, x in zip(pair[ok], l[ok], strict=True)]
    for s, e in zip(starts, ends, strict=True):
        if e - s < 3:
            continue
        rank = np.argsort(np.ascontiguousarray(left[s:e]).view(f"S{reach}").ravel(), kind="stable")
        place = np.empty(e - s, np.int64)
        place[rank] = np.arange(e - s)
        for depth, lo, hi in interval_tree(lcp[s : e - 1]):
            if depth + reach < length:
                continue
            members = s + lo + np.argsort(place[lo : hi + 1], kind="stable")
            l = _common(left[members[:-1]], left[members[1:]], np.minimum(n_left[members[:-1]], n_left[members[1:]]))
            enough = l + depth >= length
            if not enough.any():
                continue
            best = np.maximum(np.r_[l * enough, 0], np.r_[0, l * enough])
            hit = np.r_[enough, False] | np.r_[False, enough]
            at = members[hit]
            cover[at, 0] = np.maximum(cover[at, 0], best[hit])
            cover[at, 1] = np.maximum(cover[at, 1], depth)
            if groups:
                child = np.r_[0, np.cumsum(lcp[s + lo : s + hi] == depth)]
                found = [(x, a, b) for x, a, b in interval_tree(np.where(enough, l + 1, 0))]
                for x, a, b in found:
                    inside = members[a : b + 1]
                    if depth == frame.right or len(np.unique(child[inside - s - lo])) > 1:
                        repeats.append((x - 1, depth, order[inside]))
    out = np.empty_like(cover)
    out[order] = cover
    return out, repeats


def _keys(length: int, n: int):
    """Pairs of a gram's key and a row: of a chunk's pairs with equal keys two in the key's bucket, with how many more there are; the others,
    which are repeated for certain, in buckets from n on, dealt by row."""

    def run(batches):
        for batch in batches:
            for ids, texts in C.text_chunks(batch):
                rids = np.array(ids, np.int64)
                found = [(i, *np.unique(h, return_counts=True)) for i, _, h in anchors([(t or "").encode() for t in texts], length)]
                if not found:
                    continue
                keys = np.concatenate([np.repeat(k, np.minimum(c, 2)) for _, k, c in found])
                rid = np.concatenate([np.repeat(rids[i], np.minimum(c, 2).sum()) for i, _, c in found])
                more = _ranks(keys) > 1
                bucket = np.where(more, n + rid % n, (keys >> np.uint64(32)).astype(np.int64) % n)
                yield marked(C.packed(bucket, [keys, rid], ["keys", "rids"]), False)
                if more.any():
                    many, count = np.unique(keys[more], return_counts=True)
                    yield marked(C.packed((many >> np.uint64(32)).astype(np.int64) % n, [many, count.astype(np.int64)], ["keys", "rids"]), True)

    def marked(batch: pa.RecordBatch, counts: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([counts] * batch.num_rows)], [*batch.schema.names, "counts"])

    return run


def _repeated(n: int, hot: int):
    """The keys of each row that stand at two places or more; and (hot) the keys of more than `hot` places, as rid."""

    def run(table: pa.Table) -> pa.Table:
        counts = table.filter(table.column("counts"))
        pairs = table.filter(pa.compute.invert(table.column("counts")))
        keys, rids = C.unpacked(pairs, "keys", np.uint64), C.unpacked(pairs, "rids", np.int64)
        many = np.empty(0, np.uint64)
        if table.column("bucket")[0].as_py() < n:
            distinct, of, places = np.unique(keys, return_inverse=True, return_counts=True)
            keep = places[of] > 1
            np.add.at(places, np.searchsorted(distinct, C.unpacked(counts, "keys", np.uint64)), C.unpacked(counts, "rids", np.int64))
            many = distinct[places > hot]
            keys, rids = keys[keep], rids[keep]
        order = np.lexsort((keys, rids))
        keys, rids = keys[order], rids[order]
        starts = np.flatnonzero(np.r_[True, rids[1:] != rids[:-1]]) if len(rids) else np.empty(0, np.int64)
        ends = np.r_[starts[1:], len(rids)].astype(np.int64)
        lists = [np.unique(keys[s:e]).tobytes() for s, e in zip(starts, ends[: len(starts)], strict=True)]
        rid = np.r_[rids[starts], many.view(np.int64)]
        flags = [False] * len(starts) + [True] * len(many)
        columns = {"rid": pa.array(rid, pa.int64()), "bit": pa.array(C.bit_hash(rid), pa.int64()), "keys": pa.array(lists + [b""] * len(many), pa.binary())}
        return pa.table(columns | {"hot": pa.array(flags, pa.bool_())})

    return run


def _widest(rids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of covers (anchor, left, right) the widest of each row and anchor, sorted by row and anchor."""
    order = np.lexsort((data[:, 0], rids))
    rids, data = rids[order], data[order]
    if not len(rids):
        return rids, data
    starts = np.flatnonzero(np.r_[True, (rids[1:] != rids[:-1]) | (data[1:, 0] != data[:-1, 0])])
    return rids[starts], np.maximum.reduceat(data, starts, axis=0)


def _around(frame: Frame, n: int, hot: np.ndarray | None = None, collapse: bool = False):
    """Rows of the anchors whose grams stand in two places at least, equal ones of a text twice at most. With `collapse`, equal ones of a
    chunk of texts too: the others' covers are known, and are passed on in buckets from n on, dealt by row; and the strings over anchors
    of `hot` keys in buckets from 2 n on, dealt by string."""

    def known(rids, data):
        rids, data = _widest(rids, data)
        return C.packed(n + rids % n, [data, rids, data[:, 0].astype(np.int64)], NAMES)

    def by_text(of, part):
        """The members of `part` by text; `of` is sorted."""
        which, first = np.unique(of[part], return_index=True)
        return zip(which, np.split(part, first[1:]), strict=True)

    def strings(texts, of, at, keys, rids):
        """Strings over hot anchors: two of equal ones of a piece are sent, the others are covered for certain."""
        for s in range(0, len(at), 4096):
            part = np.arange(s, min(s + 4096, len(at)))
            found = []
            for i, mine in by_text(of, part):
                h, h2, own, left = windows(texts[i], at[mine], keys[mine], frame.length)
                found.append((h, h2, mine[own], left))
            h, h2, own, left = (np.concatenate(x) for x in zip(*found, strict=True))
            more = _ranks(h, h2) > 1
            sent = ~more
            where = 2 * n + (h[sent] >> np.uint64(32)).astype(np.int64) % n
            yield C.packed(where, [np.stack([h[sent], h2[sent]], axis=1), rids[own[sent]], at[own[sent]] * WIDE + left[sent]], NAMES)
            yield known(rids[own[more]], np.stack([at[own[more]], left[more], frame.length - left[more]], axis=1))

    def chunk(texts, rids_of, wanted):
        found = []
        for i, text in enumerate(texts):
            for _, at, h in anchors([text], frame.length):
                keep = np.isin(h, wanted[i])
                at, h = at[keep], h[keep]
                first, count, _, same = same_contexts(text, at, frame)
                order = np.argsort(first)
                chosen = np.repeat(order, np.minimum(count[order], 2))
                found.append((np.full(len(chosen), i), at[first[chosen]], h[first[chosen]], same[chosen]))
        if not found:
            return
        of, at, keys, same = (np.concatenate(x) for x in zip(*found, strict=True))
        rids = rids_of[of]
        if collapse:
            more = _ranks(same) > 1
            sizes = np.array([len(t) for t in texts])[of[more]]
            yield known(rids[more], np.stack([at[more], np.minimum(at[more], frame.left), np.minimum(sizes - at[more], frame.right)], axis=1))
            of, at, keys, rids = (x[~more] for x in (of, at, keys, rids))
            if hot is not None:
                many = C.is_marked(hot, keys.view(np.int64))
                yield from strings(texts, *(x[many] for x in (of, at, keys, rids)))
                of, at, keys, rids = (x[~many] for x in (of, at, keys, rids))
        for s in range(0, len(at), piece):
            part = np.arange(s, min(s + piece, len(at)))
            rows = [_rows(texts[i], at[x], keys[x], frame) for i, x in by_text(of, part)]
            yield C.packed((keys[part] >> np.uint64(32)).astype(np.int64) % n, [np.concatenate(rows), rids[part], at[part]], NAMES)

    def run(batches):
        for batch in batches:
            texts, rids, wanted, size = [], [], [], 0
            for i in range(batch.num_rows):
                texts.append((batch.column("text")[i].as_py() or "").encode())
                rids.append(batch.column("rid")[i].as_py())
                wanted.append(np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in batch.column("keys")[i].as_py()])))
                size += len(texts[-1])
                if size > 2_000_000 or i + 1 == batch.num_rows:
                    yield from (x for x in chunk(texts, np.array(rids, np.int64), wanted) if x is not None)
                    texts, rids, wanted, size = [], [], [], 0

    piece = max(2, (1 << 24) // frame.width)
    return run


NAMES, WIDE = ["rows", "rids", "pos"], 1 << 16


def _covered(frame: Frame, n: int):
    """Covers (anchor, left, right) by row: those of a bucket's suffix array, known ones, or those of equal strings of hot anchors."""

    def run(table: pa.Table) -> pa.Table:
        rids, pos = C.unpacked(table, "rids", np.int64), C.unpacked(table, "pos", np.int64)
        kind = table.column("bucket")[0].as_py() // n
        if kind == 0:
            cover, _ = scan(C.unpacked(table, "rows", np.uint8).reshape(-1, frame.width), frame)
            hit = cover.sum(axis=1) >= frame.length
            rids, data = rids[hit], np.stack([pos[hit], cover[hit, 0], cover[hit, 1]], axis=1)
        elif kind == 1:
            data = C.unpacked(table, "rows", np.int64).reshape(-1, 3)
        else:
            h = C.unpacked(table, "rows", np.uint64).reshape(-1, 2)
            order = np.lexsort((h[:, 1], h[:, 0]))
            same = (h[order[1:]] == h[order[:-1]]).all(axis=1)
            hit = order[np.r_[same, False] | np.r_[False, same]]
            rids, left = rids[hit], pos[hit] % WIDE
            data = np.stack([pos[hit] // WIDE, left, frame.length - left], axis=1)
        rids, data = _widest(rids, data)
        starts = np.flatnonzero(np.r_[True, rids[1:] != rids[:-1]]) if len(rids) else np.empty(0, np.int64)
        ends = [*starts[1:].tolist(), len(rids)]
        return pa.table({"rid": pa.array(rids[starts], pa.int64()), "cover": pa.array([data[s:e].astype(np.int64).tobytes() for s, e in zip(starts, ends[: len(starts)], strict=True)], pa.binary())})

    return run


def _groups(frame: Frame):
    def run(table: pa.Table) -> pa.Table:
        rows = C.unpacked(table, "rows", np.uint8).reshape(-1, frame.width)
        rids, pos = C.unpacked(table, "rids", np.int64), C.unpacked(table, "pos", np.int64)
        reach, out = frame.left, []
        for left, depth, members in scan(rows, frame, groups=True)[1]:
            r = rows[members[0]]
            text = r[8 : 8 + left][::-1].tobytes() + r[8 + reach : 8 + reach + depth].tobytes()
            own = np.concatenate([at for _, at, _ in anchors([text], frame.length)])
            # elsewhere the string may lack an anchor that it doesn't have by itself; its own ones stand at all its places
            if left not in own or (left < reach and left != own.min()):
                continue
            name = hashlib.sha256(text).hexdigest()[:32]
            out += [(name, left + depth, rid, at, left) for rid, at in {(int(rids[m]), int(pos[m])) for m in members}]
        return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate((("group_id", pa.string()), ("length", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("left", pa.int64())))})

    return run


def _everywhere(frame: Frame):
    """Each member of a group, which stands for all anchors of its text with equal surroundings, at all of them."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column("text")[i].as_py() or "").encode()
                places: dict[int, list[int]] = {}
                for _, at, _ in anchors([text], frame.length):
                    first, _, of, _ = same_contexts(text, at, frame)
                    for a, k in zip(at.tolist(), of.tolist(), strict=True):
                        places.setdefault(int(at[first[k]]), []).append(a)
                out = {(m["group_id"], m["length"], a - m["left"]) for m in batch.column("members")[i].as_py() for a in places[m["at"]]}
                if out:
                    group, size, start = zip(*sorted(out), strict=True)
                    rid = pa.array([batch.column("rid")[i].as_py()] * len(out), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(group, pa.string()), pa.array(size, pa.int64()), rid, pa.array(start, pa.int64())], ["group_id", "length", "rid", "start"])

    return run


def _spans(text: bytes, cover: dict[int, tuple[int, int]], frame: Frame) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    if cover:
        for _, at, _ in anchors([text], frame.length):
            first, _, of, _ = same_contexts(text, at, frame)
            for a, i in zip(at.tolist(), of.tolist(), strict=True):
                if c := cover.get(int(at[first[i]])):
                    spans.append((a - c[0], a + c[1]))
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    return [tuple(x) for x in merged]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary"


def _cut(frame: Frame, joined: bool, keep_text: bool):
    def run(batches):
        for batch in batches:
            out = []
            covers = batch.column("covers").to_pylist() if joined else None
            ids = batch.column("doc_id").to_pylist()
            for i in range(batch.num_rows):
                text = (batch.column("text")[i].as_py() or "").encode()
                cover = {}
                for x in (covers[i] or []) if joined else []:
                    for p, l, r in np.frombuffer(x, np.int64).reshape(-1, 3).tolist():
                        old = cover.get(p, (0, 0))
                        cover[p] = (max(l, old[0]), max(r, old[1]))
                spans = _spans(text, cover, frame)
                kept, last = [], 0
                for s, e in spans:
                    kept.append(text[last:s])
                    last = e
                kept = b"".join([*kept, text[last:]])
                out.append((ids[i], len(text), len(text) - len(kept), len(spans), [{"start": s, "end": e} for s, e in spans], kept if keep_text else hashlib.sha256(kept).hexdigest().encode()))
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), spans_type, pa.binary()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return run


def _prepare(docs: DataFrame, id_col: str, text_col: str, frame: Frame, collapse: bool = False, hot: int = HOT):
    spark = docs.sparkSession
    n = C.bucket_count(spark)
    docs = C.id_and_text(docs, id_col, text_col)
    docs = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    packed = docs.select(F.col("rid").alias("doc_id"), "text").mapInArrow(_keys(frame.length, n), "bucket int, keys binary, rids binary, counts boolean")
    repeated = C.checkpoint(packed.groupBy("bucket").applyInArrow(_repeated(n, hot), "rid long, bit long, keys binary, hot boolean"))
    many = C.marked(repeated.where("hot")) if collapse else None
    repeated = repeated.where("not hot")
    flags = C.marked(repeated)

    def split(wanted: bool):
        def run(batches):
            for batch in batches:
                keep = C.is_marked(flags, np.array(batch.column("rid").to_pylist(), np.int64))
                yield batch.filter(pa.array(keep == wanted))

        return docs.mapInArrow(run, docs.schema)

    of = repeated.groupBy("rid").agg(F.collect_list("keys").alias("keys"))
    around = split(True).join(of, "rid").select("rid", "text", "keys")
    around = around.mapInArrow(_around(frame, n, many if collapse and many.any() else None, collapse), "bucket int, rows binary, rids binary, pos binary")
    return docs, split, around, n


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = MIN_LENGTH, keep_text: bool = True, hot: int = HOT) -> DataFrame:
    """For each row: its id, n_bytes, n_removed, n_spans, spans (bytes, end exclusive) and kept: the remaining bytes, or without
    keep_text the sha256 of them in hex. hot: places of a gram beyond which strings are dealt one by one; the result is the same."""
    frame = narrow(length)
    docs, split, around, n = _prepare(docs, id_col, text_col, frame, True, hot)
    cover = C.checkpoint(around.groupBy("bucket").applyInArrow(_covered(frame, n), "rid long, cover binary"))
    cover = cover.groupBy("rid").agg(F.collect_list("cover").alias("covers"))
    some = split(True).join(cover, "rid", "left").select("doc_id", "text", "covers").mapInArrow(_cut(frame, True, keep_text), RESULT)
    none = split(False).select("doc_id", "text").mapInArrow(_cut(frame, False, keep_text), RESULT)
    return some.unionByName(none)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = MIN_LENGTH, reach: int = REACH) -> DataFrame:
    """All occurrences of all maximal repeats of `length` to `reach` bytes: group_id, length, doc_id, start (in bytes). Longer repeats are
    given in pieces. reach: 65535 at most."""
    frame = Frame(length, reach, reach)
    docs, split, around, _ = _prepare(docs, id_col, text_col, frame)
    found = around.groupBy("bucket").applyInArrow(_groups(frame), "group_id string, length long, rid long, at long, left long")
    found = found.groupBy("rid").agg(F.collect_list(F.struct("group_id", "length", "at", "left")).alias("members"))
    texts = split(True).select("rid", "text").dropDuplicates(["rid"])
    found = texts.join(found, "rid").mapInArrow(_everywhere(frame), "group_id string, length long, rid long, start long")
    return found.join(docs.select("rid", "doc_id").distinct(), "rid").drop("rid")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(C.read(spark, sf_dir, "documents"), keep_text=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))

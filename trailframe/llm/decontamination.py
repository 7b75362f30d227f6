"""Benchmark passages in documents, by spaced seeds.

Words are runs of letters and digits in lower case. A seed is a mask over successive words whose zeros are ignored; every passage that
the verification accepts holds one of the masks. Hashes of all masks at all places of the benchmark are joined with those of all places
of the documents; each hit fixes an alignment of an item and a document. It holds if any stretch of it has `least_equal` equal words and
is equal in SHARE of its words; of these stretches the one with the most equal words counts, then the first. Of passages of one item that
overlap in a document (as in repetitive texts) the one with the most equal words is reported, then the first.

An item has to have SHORTEST words; shorter ones are no passages. Items of up to four words must be found whole, longer ones in SHARE of
their words, and of items of 15 words and more MATCHES equal words suffice.

The join: a benchmark of up to BLOCK_BYTES of text is broadcast as a table of seeds and verified in the same pass over the documents. A
larger one is joined by a shuffle of seeds: those of the documents that a bit filter of 1 MB lets through meet those of the items, and the
texts of documents with a hit meet the items that were hit. Both ways find the same passages.

Null and empty texts and items match nothing; a repeated item gives one row; an empty table gives an empty result. Null ids are kept;
repeated rows have equal results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm import common as C

#: Of 12 equal words or more and a quarter as many others at most, four stand in a row, or they stand 3 + 3 + 3 + 3.
MASKS = ("1111", "1110111")
#: Fixed: what else an item of so many words needs, with one or two words changed.
SHORT_MASKS = {3: ("111",), 5: ("11011", "10111", "11101"), 6: ("110111", "111011"), 10: ("111011", "110111")}
MATCHES, SHARE, SHORTEST = 12, 0.8, 3
BLOCK_BYTES = 16_000_000
#: Seeds of texts that meet the items of one bucket in one task of the shuffled join, or those of one chunk of texts.
PART = 1 << 20
#: Hits, and words compared, at a time.
PIECE = 1_000_000
_TABLE_BITS = 22


def least_equal(n: int) -> int:
    """Equal words that an item of n words has to have."""
    return min(MATCHES, -(-4 * n // 5))


def masks_of(n: int) -> tuple[str, ...]:
    if n < SHORTEST:
        return ()
    return tuple(m for m in (*MASKS, *SHORT_MASKS.get(n, ())) if len(m) <= n)


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    out = np.zeros(max(0, len(h) - len(mask) + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i, x in enumerate(mask):
            if x == "1":
                out = out * np.uint64(0x9FB21C651E98DF25) + h[i : i + len(out)]
        return C.mix(out * np.uint64(0xD6E8FEB86659FD93) + np.uint64(int(mask, 2) + (1 << len(mask))))


ALL_MASKS = tuple(dict.fromkeys((*MASKS, *(m for ms in SHORT_MASKS.values() for m in ms))))


class Items:
    """Words of benchmark items, by number."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.flat, self.size = C.word_hashes([t for _, t in items], letters=True)
        self.first = np.r_[0, np.cumsum(self.size)][:-1].astype(np.int64)
        self.least = np.array([least_equal(int(n)) for n in self.size], np.int64)

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seed, item and place of every mask that an item needs, in order of seeds."""
        parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
        for i, (at, n) in enumerate(zip(self.first.tolist(), self.size.tolist(), strict=True)):
            for mask in masks_of(n):
                s = _seeds(self.flat[at : at + n], mask)
                parts.append((s, np.full(len(s), i, np.int64), np.arange(len(s))))
        seeds, item, place = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.argsort(seeds, kind="stable")
        return seeds[order], item[order], place[order]

    def verified(self, hits: np.ndarray, h: np.ndarray, ends: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Of alignments (text, item, place of the item's first word in all words of the texts) those that hold, the best of overlapping
        ones: text, item, first word, word after the last, equal words."""
        found = []
        for doc, item, start in self._enough(hits, h, ends, n):
            first, at, size = int(ends[doc] - n[doc]), int(self.first[item]), int(self.size[item])
            lo, hi = max(first, start), min(int(ends[doc]), start + size)
            same = h[lo:hi] == self.flat[at + lo - start : at + hi - start]
            s, e = _widest(same)
            equal = int(same[s:e].sum())
            if equal >= self.least[item] and equal >= SHARE * (e - s):
                found.append((doc, item, lo - first + s, lo - first + e, equal))
        return _apart(found)

    def _enough(self, hits: np.ndarray, h: np.ndarray, ends: np.ndarray, n: np.ndarray) -> Iterator[list[int]]:
        """The alignments with as many equal words as a passage needs, wherever they stand."""
        doc, item, start = hits.T
        lo, hi = np.maximum(ends[doc] - n[doc], start), np.minimum(ends[doc], start + self.size[item])
        total = np.cumsum(hi - lo)
        cut = np.searchsorted(total, np.arange(0, max(1, int(total[-1]) if len(total) else 1), PIECE))
        for a, b in zip(cut, [*cut[1:], len(hits)], strict=True):
            if a == b:
                continue
            long = (hi - lo)[a:b]
            first = np.cumsum(long) - long
            at = np.arange(long.sum()) - np.repeat(first, long)
            same = h[np.repeat(lo[a:b], long) + at] == self.flat[np.repeat(self.first[item[a:b]] + (lo - start)[a:b], long) + at]
            yield from hits[a:b][np.add.reduceat(same, first, dtype=np.int64) >= self.least[item[a:b]]].tolist()


class Index(Items):
    """Items with their seeds, and a table of bits in front."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        super().__init__(items)
        self.seed, self.item, self.place = self.seeds()
        sizes = set(self.size.tolist())
        self.masks = [m for m in ALL_MASKS if any(m in masks_of(n) for n in sizes)]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.seed >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, word after the last, equal words) for each passage."""
        h, n = C.word_hashes(texts, letters=True)
        ends = np.cumsum(n)
        hits = [np.empty((0, 3), np.int64)]
        for mask in self.masks:
            s = _seeds(h, mask)
            at = np.flatnonzero(self.table[(s >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.seed, s[at], "left"), np.searchsorted(self.seed, s[at], "right")
            at, lo, hi = (x[hi > lo] for x in (at, lo, hi))
            doc = np.searchsorted(ends, at, side="right")
            whole = at + len(mask) <= ends[doc] if len(at) else np.zeros(0, bool)
            at, lo, hi, doc = (x[whole] for x in (at, lo, hi, doc))
            hits.append(_diagonals(doc, at, lo, hi - lo, self.item, self.place))
        return self.verified(np.unique(np.concatenate(hits), axis=0), h, ends, n)


def _diagonals(doc: np.ndarray, at: np.ndarray, lo: np.ndarray, count: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The alignments (text, item, start) of hits, once each. Hits are expanded in pieces: there are many more of them than alignments
    where a text or an item repeats itself."""
    out = [np.empty((0, 3), np.int64)]
    cut = np.searchsorted(np.cumsum(count), np.arange(0, max(1, int(count.sum())), PIECE), side="left")
    for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
        if a < b:
            c = count[a:b]
            which = np.repeat(lo[a:b], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            out.append(np.unique(np.stack([np.repeat(doc[a:b], c), item[which], np.repeat(at[a:b], c) - place[which]], 1), axis=0))
    return np.unique(np.concatenate(out), axis=0)


def _apart(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of passages of one item in one text that overlap in a chain, the one with the most equal words, then the first."""
    out: list[tuple[int, int, int, int, int]] = []
    end, last = 0, None
    for p in sorted(found):
        if last == p[:2] and p[2] < end:
            if p[4] > out[-1][4]:
                out[-1] = p
            end = max(end, p[3])
        else:
            out.append(p)
            last, end = p[:2], p[3]
    return out


def _widest(same: np.ndarray) -> tuple[int, int]:
    """Of the stretches that are equal in SHARE of their words, that with the most equal words, from an equal word to an equal word."""
    equal = np.r_[0, np.cumsum(same)]
    total = np.rint(1000 * (equal - SHARE * np.arange(len(equal)))).astype(np.int64)  # a stretch holds if this does not fall over it
    lowest = np.minimum.accumulate(total)
    start = np.searchsorted(-lowest, -total, side="left")  # the first place that is not higher
    e = int(np.argmax(equal - equal[start]))
    s = int(start[e])
    return (s + int(np.argmax(same[s:e])) if e > s else s), e


HITS = "doc_id long, item_id long, start long, end long, n_equal long, key long"
_NAMES = [x.split()[0] for x in HITS.split(", ")]


def _finder(items):
    state: list[Index] = []

    def run(batches):
        if not state:
            state.append(Index(items.value))
        index = state[0]
        for batch in batches:
            keys = batch.column("key").to_pylist()
            at, out = 0, []
            for ids, texts in C.text_chunks(batch):
                out += [(ids[d], index.ids[i], s, e, q, keys[at + d]) for d, i, s, e, q in index.find(texts)]
                at += len(ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(6)], _NAMES)

    return run


def _sought(benchmark: DataFrame, item_col: str, item_text: str) -> tuple[DataFrame, bool]:
    """Items with a text, once each, and whether they are to be broadcast."""
    items = C.id_and_text(benchmark, item_col, item_text).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    return items, size <= BLOCK_BYTES


def _broadcast(items: DataFrame):
    """At most BLOCK_BYTES of items, in a fixed order."""
    rows = sorted(((r[0], r[1]) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return items.sparkSession.sparkContext.broadcast(rows)


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start, end (in words of letters and digits), n_equal, key (hash of id and text) for each passage found."""
    docs = C.id_and_text(docs, id_col, text_col)
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    items, small = _sought(benchmark, item_col, item_text)
    return docs.mapInArrow(_finder(_broadcast(items)), HITS) if small else _joined(docs, items)


def _item_seeds(n: int):
    """Of items (item key and text), a row for each bucket: seeds, items and places."""

    def run(batches):
        for batch in batches:
            keys = np.array(batch.column("item").to_pylist(), np.int64)
            seeds, item, place = Items([*zip(keys.tolist(), batch.column("text").to_pylist(), strict=True)]).seeds()
            if len(seeds):
                yield C.packed((seeds % np.uint64(n)).astype(np.int64), [seeds, keys[item], place], ["seeds", "keys", "places"])

    return run


def _bits(batches):
    for batch in batches:
        for x in batch.column("seeds"):
            yield pa.RecordBatch.from_arrays([pa.array(C.bit_hash(np.frombuffer(x.as_py(), np.int64)))], ["bit"])


def _text_seeds(flags, n: int):
    """As _item_seeds for all masks of texts, only of seeds that the filter lets through."""

    def run(batches):
        for batch in batches:
            for keys, texts in C.text_chunks(batch, name="key"):
                h, count = C.word_hashes(texts, letters=True)
                ends, own = np.cumsum(count), np.array(keys, np.int64)
                for mask in ALL_MASKS:
                    s = _seeds(h, mask)
                    place = np.flatnonzero(C.is_marked(flags, s.view(np.int64)))
                    doc = np.searchsorted(ends, place, side="right")
                    whole = place + len(mask) <= ends[doc] if len(place) else np.zeros(0, bool)
                    place, doc = place[whole], doc[whole]
                    if len(place):
                        yield C.packed((s[place] % np.uint64(n)).astype(np.int64), [s[place], own[doc], place - (ends - count)[doc]], ["seeds", "keys", "places"])

    return run


def _meet(_key, texts: pa.Table, items: pa.Table) -> pa.Table:
    """Text key, item key and start of the alignments of one bucket of seeds, once each."""
    schema = pa.schema([("key", pa.int64()), ("item", pa.int64()), ("start", pa.int64())])
    if not len(texts) or not len(items):
        return schema.empty_table()
    seed, item, place = C.unpacked(items, "seeds", np.uint64), C.unpacked(items, "keys", np.int64), C.unpacked(items, "places", np.int64)
    order = np.argsort(seed, kind="stable")
    seed, item, place = seed[order], item[order], place[order]
    s, key, at = C.unpacked(texts, "seeds", np.uint64), C.unpacked(texts, "keys", np.int64), C.unpacked(texts, "places", np.int64)
    lo, hi = np.searchsorted(seed, s, "left"), np.searchsorted(seed, s, "right")
    key, at, lo, hi = (x[hi > lo] for x in (key, at, lo, hi))
    rows = _diagonals(key, at, lo, hi - lo, item, place)
    return pa.table([pa.array(rows[:, i]) for i in range(3)], schema=schema)


def _checked(batches):
    """Of a text, an item and the starts where they may match, the passages that hold."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            items = Items([(batch.column("item_id")[i].as_py(), batch.column("item_text")[i].as_py())])
            h, n = C.word_hashes([batch.column("text")[i].as_py()], letters=True)
            starts = np.unique(np.array(batch.column("starts")[i].as_py(), np.int64))
            hits = np.stack([np.zeros_like(starts), np.zeros_like(starts), starts], 1)
            out += [(batch.column("doc_id")[i].as_py(), items.ids[0], s, e, q, batch.column("key")[i].as_py()) for _, _, s, e, q in items.verified(hits, h, np.cumsum(n), n)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(6)], _NAMES)


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The passages by a shuffled join of seeds. A seed that very many texts hold fills its bucket, so the texts' seeds of a bucket are
    dealt over as many tasks as they need, and the bucket's items go to each of them."""
    n = C.bucket_count(docs.sparkSession)
    items = items.select(F.xxhash64("doc_id", "text").alias("item"), F.col("doc_id").alias("item_id"), "text")
    seeds = C.checkpoint(items.select("item", "text").mapInArrow(_item_seeds(n), "bucket int, seeds binary, keys binary, places binary"))
    flags = C.marked(seeds.select("seeds").mapInArrow(_bits, "bit long"))
    found = docs.select("key", "text").mapInArrow(_text_seeds(flags, n), "bucket int, seeds binary, keys binary, places binary")
    found = C.checkpoint(found)
    loads = found.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("seeds")) / F.lit(8 * PART)).alias("parts"))
    loads = C.checkpoint(loads)  # a row for each bucket at most
    part = F.pmod(F.xxhash64("keys", "places"), F.col("parts")).alias("part")
    dealt = found.join(F.broadcast(loads), "bucket").select("bucket", part, "seeds", "keys", "places")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    copied = seeds.join(F.broadcast(loads), "bucket").select("bucket", each, "seeds", "keys", "places")
    hits = dealt.groupBy("bucket", "part").cogroup(copied.groupBy("bucket", "part")).applyInArrow(_meet, "key long, item long, start long")
    hits = C.checkpoint(hits.distinct())
    pairs = hits.groupBy("key", "item").agg(F.collect_list("start").alias("starts"))  # at most a place for each word of text and item
    near = docs.join(hits.select("key").distinct(), "key", "left_semi")
    near = near.join(pairs, "key").join(items.withColumnRenamed("text", "item_text"), "item")
    return near.select("doc_id", "key", "text", "item_id", "item_text", "starts").mapInArrow(_checked, HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no passage of the benchmark was found, with all their columns. A benchmark that is broadcast takes one
    pass and no shuffle; else only rows that a bit filter of the hits marks are shuffled."""
    items, small = _sought(benchmark, "item_id", "text")
    if small:
        book = _broadcast(items)
        state: list[Index] = []
        text = docs.columns.index("text")

        def run(batches):
            if not state:
                state.append(Index(book.value))
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                at = 0
                for ids, texts in C.text_chunks(batch.select([text]).append_column("doc_id", pa.nulls(batch.num_rows, pa.int64()))):
                    keep[[at + d for d, *_ in state[0].find(texts)]] = False
                    at += len(ids)
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)
    key = "__key"
    while key in docs.columns:
        key += "_"
    hit = find_passages(docs, benchmark).select(F.col("key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    return C.without_keys(keyed, key, C.checkpoint(hit)).drop(key)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """A row for each document with a passage of the benchmark: its items, passages and longest passage in words."""
    hits = find_passages(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
    return hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_passages"), F.max("n_equal").alias("longest"))

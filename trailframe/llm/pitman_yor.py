"""Scores of texts by a hierarchical Pitman-Yor language model, learned over the whole corpus.

A token is drawn in the restaurant of its context. There are three levels. A word that makes up 2^-FREQUENT of all training words or more
is a context of its own (there can be 2^FREQUENT of them at most). Its restaurant has the restaurant of its class as parent: the last two
bytes of the word, hashed to CLASSES classes. Words after rarer ones are drawn in the restaurant of the class itself, and the first word
of a text in a class of its own. All classes share one parent, whose base is uniform over the vocabulary and one unknown word.

Words are told apart by 49 bits of a hash. Counts of (word, context) meet packed by word, so all customers of a dish, on all levels, are in
one bucket. Gibbs sampling works on the number of tables of each dish in each restaurant: a customer leaves (it sat alone with the
probability that seating plans of so many customers at so many tables have, a ratio of generalised Stirling numbers; see `alone`) and is
seated again at a table of the dish or at a new one, whose dish comes from the parent. A table that closes takes a customer out of the
parent at once, one that opens sends it one, and so on up. In a sweep every customer of every restaurant moves once, from the contexts up
(`Seating.sweep`). The customers of a word on a level move one after the other; where they have more than LANE tables, at most one in LANE
closes or opens at once, and no more than leave each dish a table and each table a customer. Words move side by side: a move sees the tables
of others that move at once as they are before the step. Buckets sample on their own; what a restaurant has in other buckets is taken to be
as much, for its customers, as here at the start of each sweep of a level. The last SAMPLES sweeps are kept. With totals of all buckets, each
sample's predictive probabilities sum to one; a token's probability is their average. Discounts are n1 / (n1 + 2 n2) of the counts of each
level.

To score, words whose pairs fit HEAD_PAIRS are broadcast, most frequent first; tokens of all other words travel packed to the bucket of
their word. A null or empty text is one end token. An empty training set leaves the uniform base; no texts to score give no rows. A null id
is not held out. Repeated rows are counted and scored as often as they occur. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm import common as C

FREQUENT, CLASSES = 14, 256
#: Contexts by number: the classes, the start of a text, then frequent words. A key is a word's hash above and a context's number below.
START, FIRST_WORD = CLASSES, CLASSES + 1
_BITS = 15
_LOW = np.uint64((1 << _BITS) - 1)
SWEEPS, SAMPLES = 4, 3
#: Tables of a word on a level, of which one at most closes or opens at a time.
LANE = 32
HEAD_PAIRS = 1 << 20
CONCENTRATION = 1.0
END = np.uint64(0x5851F42D4C957F2D) & ~_LOW
#: Customers up to which ratios of Stirling numbers are tabled; above, their asymptotic form holds.
TABLED = 512
#: Buckets at least, and what a bucket has of the texts.
BUCKETS, BUCKET_CHARACTERS = 32, 2_500_000


def token_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the tokens of all texts in turn, each text with its end: the word, the word before (0 at the start of a text), the class of that
    word; and the number of tokens of each text."""
    h, last, counts = C.word_hashes_and_ends(texts)
    n = len(h) + len(texts)
    at = np.arange(len(h)) + np.repeat(np.arange(len(texts)), counts)
    words, before, kind = np.full(n, END, np.uint64), np.zeros(n, np.uint64), np.full(n, START, np.uint64)
    words[at] = h & ~_LOW
    before[at + 1] = words[at]
    kind[at + 1] = C.mix(last.astype(np.uint64)) & np.uint64(CLASSES - 1)
    first = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64) + np.arange(len(texts))
    before[first], kind[first] = 0, START
    return words, before, kind, counts + 1


class Contexts:
    """The frequent words, and their classes."""

    def __init__(self, words: np.ndarray, kinds: np.ndarray):
        order = np.argsort(words)
        self.words = words[order]
        self.parent = np.r_[np.arange(FIRST_WORD), kinds[order].astype(np.int64)]
        self.n = len(self.parent)

    def keys(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word and context of each token, and the number of tokens of each text."""
        words, before, kind, counts = token_words(texts)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, before), len(self.words) - 1)
            kind = np.where(self.words[at] == before, (at + FIRST_WORD).astype(np.uint64), kind)
        return words | kind, counts


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts, at)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(_BITS)) % np.uint64(n)).astype(np.int64)


PACKED = "bucket int, n long, keys binary, counts binary"
_PACKED = [x.split()[0] for x in PACKED.split(", ")]


def _packed(buckets: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket, of keys that ascend."""
    order = np.argsort(buckets, kind="stable")
    b, keys, counts = buckets[order], keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    parts = [*zip(starts, [*starts[1:], len(b)], strict=True)]
    columns = [
        pa.array(b[starts].astype(np.int32)), pa.array([int(e - s) for s, e in parts], pa.int64()),
        pa.array([C.squeezed(keys[s:e], True) for s, e in parts], pa.binary()), pa.array([C.squeezed(counts[s:e]) for s, e in parts], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, _PACKED)


def _opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = [*zip(*(table.column(c).to_pylist() for c in ("n", "keys", "counts")), strict=True)]
    keys = [C.unsqueezed(k, n, True) for n, k, _ in rows]
    counts = [C.unsqueezed(c, n).astype(np.int64) for n, _, c in rows]
    return _merged(np.concatenate(keys), np.concatenate(counts))


def _count(keys_of, n: int):
    """Counts of keys over all texts of a task, packed by bucket."""

    def run(batches):
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            parts = [(keys, counts)]
            for _, texts in C.text_chunks(batch, 8_000_000):
                parts.append(np.unique(keys_of(texts), return_counts=True))
            keys, counts = _merged(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
            if len(keys) > 4_000_000:
                yield _packed(bucket_of(keys, n), keys, counts)
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield _packed(bucket_of(keys, n), keys, counts)

    return run


def _words_with_class(texts: list[str | None]) -> np.ndarray:
    """Words that another token follows, with their classes."""
    _, before, kind, _ = token_words(texts)
    return (before | kind)[before > 0]


def _often(table: pa.Table) -> pa.Table:
    """Words of a bucket that may be frequent: those that are, among the bucket's tokens. 2^FREQUENT at most."""
    keys, counts = _opened(table)
    top = counts * (1 << FREQUENT) >= counts.sum()
    return pa.table({"key": pa.array(keys[top].view(np.int64)), "count": pa.array(counts[top]), "tokens": pa.array(np.where(np.arange(top.sum()) == 0, counts.sum(), 0))})


def frequent_contexts(train: DataFrame, n: int) -> Contexts:
    """Exact counts of all words decide."""
    counted = train.mapInArrow(_count(_words_with_class, n), PACKED).groupBy("bucket").applyInArrow(_often, "key long, count long, tokens long")
    counted = C.checkpoint(counted)
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    rows = counted.where(F.col("count") * (1 << FREQUENT) >= total).select("key").collect()
    keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    return Contexts(keys & ~_LOW, keys & _LOW)


def _cells(keys: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: which are of a word context; the class cells (word and class, sorted); for each key its class cell; for each class
    cell its word; the words; for each key its word."""
    context = (keys & _LOW).astype(np.int64)
    own = context >= FIRST_WORD
    up = (keys & ~_LOW) | parent[context].astype(np.uint64)
    cells, of = np.unique(up, return_inverse=True)
    words, cell_word = np.unique(cells & ~_LOW, return_inverse=True)
    return own, cells, of, cell_word, words, cell_word[of]


MERGED = "bucket int, n long, keys binary, counts binary, facts array<long>"


def _merge(parent: np.ndarray):
    """The counts of a bucket, and of them: words, tokens, ones and twos of each level, and tokens by context."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = _opened(table)
        own, cells, of, _, words, word = _cells(keys, parent)
        levels = (counts[own], np.bincount(of, weights=counts).astype(np.int64), np.bincount(word, weights=counts).astype(np.int64))
        context = np.bincount((keys & _LOW).astype(np.int64), weights=counts, minlength=len(parent)).astype(np.int64)
        facts = [len(words), int(counts.sum()), *(int((x == k).sum()) for x in levels for k in (1, 2)), *context.tolist()]
        columns = [table.column("bucket")[:1], pa.array([len(keys)], pa.int64()), pa.array([C.squeezed(keys, True)], pa.binary()), pa.array([C.squeezed(counts)], pa.binary()), pa.array([facts], pa.list_(pa.int64()))]
        return pa.table(columns, [x.split()[0] for x in MERGED.split(", ")])

    return run


def _totals(df: DataFrame, column: str, n: int) -> list:
    """Sums by position of the arrays of n buckets, which are of one length: of about root n buckets at a time, then of those sums."""
    kind, groups = df.schema[column].dataType.simpleString(), math.isqrt(n) + 1

    def run(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x.values) for x in table.column("x")], axis=0)
        return pa.table({"x": pa.array([total], table.schema.field("x").type)})

    rows = df.select(F.pmod("bucket", F.lit(groups)).alias("part"), F.col(column).alias("x")).groupBy("part").applyInArrow(run, f"x {kind}").collect()
    return np.sum([r["x"] for r in rows], axis=0).tolist() if rows else []


@lru_cache(8)
def _alone_table(discount: float) -> np.ndarray:
    """[c, t]: of the seating plans of c customers at t tables, weighed as the process weighs them, those in which a certain customer sits
    alone: S(c - 1, t - 1) / S(c, t)."""
    t = np.arange(TABLED + 1)
    log_s = np.full(TABLED + 1, -np.inf)
    log_s[1] = 0.0
    out = np.zeros((TABLED + 1, TABLED + 1))
    out[1, 1] = 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(2, TABLED + 1):
            one = np.r_[-np.inf, log_s[:-1]]
            other = log_s + np.log(np.maximum(c - 1 - discount * t, 0))
            new = np.logaddexp(one, other)
            out[c] = np.nan_to_num(np.exp(one - new))
            log_s = new
    return out


@lru_cache(8)
def _alone_curve(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """By the logarithm of customers a table: how many tables have one customer, by all tables, where there are very many of both. Numbers
    of plans are coefficients of (1 - (1 - x)^discount)^tables; this is the saddle point of those."""
    x = np.r_[np.geomspace(1e-9, 0.5, 2000), 1 - np.geomspace(0.5, 1e-250, 6000)[1:]]
    rest = np.r_[1 - x[:2000], np.geomspace(0.5, 1e-250, 6000)[1:]]  # 1 - x, also where x is next to 1
    power = -np.expm1(discount * np.log(rest))
    return np.log(discount * x / power) + (discount - 1) * np.log(rest), discount * x / power


def alone(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """The probability that a customer of a dish sits alone, given how many there are and at how many tables. Beyond the table it was
    found off by a share of 0.007 at most for discounts of 0.5 and 0.8, of 0.14 for one of 0.1."""
    c, t = customers.astype(np.int64, copy=False), tables.astype(np.int64, copy=False)
    many = c > TABLED
    if not many.any():
        return _alone_table(discount)[c, t]
    out = _alone_table(discount)[np.where(many, 0, c), np.where(many, 0, t)]
    c, t = c[many] - 1, t[many] - 1
    per_table, share = _alone_curve(discount)
    found = np.where(t > 0, np.minimum(t / c * np.interp(np.log(c / np.maximum(t, 1)), per_table, share), 1), 0)
    out[many] = np.where(t == c, 1, found)  # exactly, as no table may become empty
    return out


class Level:
    """Dishes in restaurants: customers, tables, and those of each restaurant, of which others hold `scale` - 1 times as many."""

    def __init__(self, restaurant: np.ndarray, n: int, scale: np.ndarray, discount: float, rng):
        self.restaurant, self.n, self.scale, self.discount, self.rng = restaurant, n, scale, float(discount), rng
        self.customers = self.tables = None
        self.mark = np.zeros(len(restaurant), np.int64)

    def tally(self) -> None:
        """Counts anew what is in each restaurant, here and in other buckets; moves then change the part of here. `own` is what a dish's
        tables weigh, `strength` what a new table weighs before its dish, `whole` all of these."""
        self.own = self.customers - self.discount * self.tables
        self.strength = CONCENTRATION + self.discount * self.scale * np.bincount(self.restaurant, weights=self.tables, minlength=self.n)
        self.whole = CONCENTRATION + self.scale * np.bincount(self.restaurant, weights=self.customers, minlength=self.n)

    def chance(self, cells, above) -> np.ndarray:
        """The predictive probabilities of dishes."""
        where = self.restaurant[cells]
        return (self.own[cells] + self.strength[where] * above) / self.whole[where]

    def settle(self, customers: np.ndarray, chance: np.ndarray) -> None:
        """Seats customers to begin with, at about as many tables as customers that come one after the other open."""
        self.customers, self.tables = customers.astype(np.int64), np.minimum(customers, 1).astype(np.int64)
        self.tally()
        cells = np.flatnonzero(self.customers > 1)
        all_of, weight, done, tables = self.customers[cells], (chance * self.strength[self.restaurant])[cells], 1, np.ones(len(cells))
        while len(cells):
            step = np.minimum(max(1, done // 4), all_of - done)
            tables += step * weight / (weight + np.maximum(done - self.discount * tables, 1e-9))
            done += max(1, done // 4)
            more = all_of > done
            self.tables[cells[~more]] = np.clip(np.rint(tables[~more]), 1, all_of[~more])
            cells, all_of, weight, tables = cells[more], all_of[more], weight[more], tables[more]
        self.tally()

    def add(self, cells: np.ndarray, customers: int, tables: int) -> None:
        """As many to each cell, as often as it comes."""
        where = self.restaurant[cells]
        np.add.at(self.own, cells, customers - self.discount * tables)
        if customers:
            np.add.at(self.customers, cells, customers)
            np.add.at(self.whole, where, float(customers))
        if tables:
            np.add.at(self.tables, cells, tables)
            np.add.at(self.strength, where, self.discount * tables)

    def once(self, cells: np.ndarray) -> np.ndarray:
        """One place of each cell."""
        at = np.arange(len(cells))
        self.mark[cells] = at
        return self.mark[cells] == at

    def within(self, cells: np.ndarray, room) -> np.ndarray:
        """Which of these may change at once: all of one cell where it has room for as many, else one of them."""
        now = self.once(cells)
        if not now.all():
            some, of, times = np.unique(cells, return_inverse=True, return_counts=True)
            now |= (room(some) >= times)[of]
        return now

    def leave(self, cells: np.ndarray) -> np.ndarray:
        """A customer of each cell leaves. Returns the cells whose table closes. Those of one cell leave at once, unless no seating plan is left
        by that; then they leave one by one."""
        closes, now = self.rng.random(len(cells)) < alone(self.customers[cells], self.tables[cells], self.discount), self.once(cells)
        if not now.all():
            some, of, times = np.unique(cells, return_inverse=True, return_counts=True)
            tables = self.tables[some] - np.bincount(of, weights=closes)
            good = (tables >= 1) & (tables <= self.customers[some] - times)
            if not good.all():
                now = good[of] | now & (times == 1)[of]
            else:
                now[:] = True
        parts, rest = [cells[now & closes]], cells[~now]
        self.add(cells[now & ~closes], -1, 0)
        self.add(parts[0], -1, -1)
        while len(rest):
            first = self.once(rest)
            parts.append(self.leave(rest[first]))
            rest = rest[~first]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def join(self, cells: np.ndarray, above) -> np.ndarray:
        """A customer of each cell takes a seat. Returns the cells where it opens a table. Those of one cell come at once, where a table is."""
        empty = self.tables[cells] == 0
        if empty.any():
            now = ~empty | self.once(cells)
            if not now.all():
                parts = [(cells[x], above if np.ndim(above) == 0 else above[x]) for x in (now, ~now)]
                return np.concatenate([self.join(*x) for x in parts])
        new = above * self.strength[self.restaurant[cells]]
        opens = (self.rng.random(len(cells)) * (new + self.own[cells]) < new) | empty
        opened = cells[opens]
        self.add(cells[~opens], 1, 0)
        self.add(opened, 1, 1)
        return opened

    def step(self, chance: np.ndarray) -> None:
        """One customer of each dish leaves and is seated again, by probabilities of the parent that stay."""
        cells = np.flatnonzero(self.customers > 0)
        self.leave(cells)
        self.join(cells, chance[cells])


class Seating:
    """Levels from the contexts up; for each cell of a level but the last, the cell above; the last one's dishes have a probability of their own."""

    def __init__(self, levels: list[Level], up: list[np.ndarray], base: float):
        self.levels, self.up, self.base = levels, up, base

    def above(self, k: int, cells: np.ndarray):
        """The probability of the dishes in the restaurant above."""
        if k + 1 == len(self.levels):
            return self.base
        cells = self.up[k][cells]
        return self.levels[k + 1].chance(cells, self.above(k + 1, cells))

    def leave(self, k: int, cells: np.ndarray) -> None:
        """A customer of each cell leaves, and those of the tables that close, above."""
        while len(cells):
            closed = self.levels[k].leave(cells)
            if k + 1 == len(self.levels):
                return
            k, cells = k + 1, self.up[k][closed]

    def join(self, k: int, cells: np.ndarray) -> None:
        """A customer of each cell takes a seat, and those of the tables that open, above."""
        while len(cells):
            opened = self.levels[k].join(cells, self.above(k, cells))
            if k + 1 == len(self.levels):
                return
            k, cells = k + 1, self.up[k][opened]

    def sweep(self, k: int, cells: np.ndarray, word: np.ndarray) -> None:
        """Every customer of a level leaves and is seated again. A dish's only customer has no choice but a table of its own, whose customer
        above moves in the sweep of that level. Cells come in the order of their words; see `lanes` for those side by side. Of a cell's moves,
        those that neither close nor open a table change nothing; how many of them come before the next that does is drawn at once."""
        level, top = self.levels[k], k + 1 == len(self.levels)
        d, rng = level.discount, level.rng
        for x in self.levels[k:]:
            x.tally()
        many = level.customers[cells] > 1
        cells = cells[many]
        place, moves, lane = lanes(word[many], level.customers[cells], level.tables[cells])
        cells = cells[place]
        at = np.flatnonzero(np.diff(lane, prepend=-1))
        end = np.r_[at[1:], len(lane)]
        left = moves[at].astype(np.float64)
        while len(at):
            cell = cells[at]
            single = alone(level.customers[cell], level.tables[cell], d)
            new = self.above(k, cell) * level.strength[level.restaurant[cell]]
            some = single + (1 - single) * (new / (new + np.maximum(level.own[cell] - 1, 1e-9)))
            with np.errstate(divide="ignore"):
                idle = np.floor(rng.standard_exponential(len(cell)) / -np.log1p(-np.minimum(some, 1)))
            moved = np.flatnonzero(idle < left)
            left = left - idle - 1
            if len(moved):
                closes = rng.random(len(moved)) * some[moved] < single[moved]
                now = np.empty(len(moved), bool)  # a dish keeps a table, and no table is empty; who would take the last draws again
                now[closes] = level.within(cell[moved[closes]], lambda x: level.tables[x] - 1)
                now[~closes] = level.within(cell[moved[~closes]], lambda x: level.customers[x] - level.tables[x])
                left[moved[~now]] += 1
                one, other = cell[moved[now & closes]], cell[moved[now & ~closes]]
                if len(other):
                    level.add(other, 0, 1)
                    if not top:
                        self.join(k + 1, self.up[k][other])
                if len(one):
                    level.add(one, -1, -1)
                    if not top:
                        self.leave(k + 1, self.up[k][one])
                    self.join(k, one)
            ready = left <= 0
            if ready.any():
                at = at + ready
                more = at < end
                at, end, left, ready = at[more], end[more], left[more], ready[more]
                left[ready] = moves[at[ready]]


def lanes(word: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deals the customers of each word, in the order of its cells, to lanes that have LANE tables each. Returns places of cells, how many of
    the cell's customers, and their lane; lanes ascend."""
    first = np.flatnonzero(np.diff(word, prepend=-1))
    before = np.cumsum(tables) - tables
    before -= np.repeat(before[first], np.diff(np.r_[first, len(word)]))
    low, high = before // LANE, (before + tables - 1) // LANE
    place = np.repeat(np.arange(len(word)), high - low + 1)
    part = np.arange(len(place)) - np.searchsorted(place, place) + low[place]
    begin, end = (np.clip(x * LANE - before[place], 0, tables[place]) * customers[place] // tables[place] for x in (part, part + 1))
    return place, end - begin, np.cumsum((np.diff(word[place], prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0)) - 1


def gibbs(keys: np.ndarray, counts: np.ndarray, parent: np.ndarray, context_totals: np.ndarray, n_words: int, discounts: tuple[float, float, float], seed: int):
    """Samples of a bucket: tables of each key (of a word context), customers and tables of each class cell, and of each word, a column for
    each sample; and the class cells and words."""
    rng = np.random.default_rng(seed)
    own, cells, of, cell_word, words, _ = _cells(keys, parent)
    context, kind = (keys & _LOW).astype(np.int64), (cells & _LOW).astype(np.int64)

    def scale(total: np.ndarray, here: np.ndarray) -> np.ndarray:
        return np.where(here > 0, total / np.maximum(here, 1), 1.0)

    here = np.bincount(context, weights=counts, minlength=len(parent))
    by_class = [np.bincount(parent, weights=x, minlength=FIRST_WORD) for x in (context_totals, here)]
    whole = scale(context_totals.sum(keepdims=True), here.sum(keepdims=True))
    leaves = Level(context[own], len(parent), scale(context_totals, here), discounts[0], rng)
    classes = Level(kind, FIRST_WORD, scale(*by_class), discounts[1], rng)
    root = Level(np.zeros(len(words), np.int64), 1, whole, discounts[2], rng)
    seating = Seating([leaves, classes, root], [of[own], cell_word], 1 / (n_words + 1))
    direct = np.bincount(of, weights=np.where(own, 0, counts), minlength=len(cells))
    uniform, samples = np.full(len(words), seating.base), []

    def seat_above(tables: np.ndarray, root_chance: np.ndarray) -> None:
        """Those above begin with customers for these tables of the contexts."""
        classes.settle(direct + np.bincount(of[own], weights=tables, minlength=len(cells)), root_chance)
        root.settle(np.bincount(cell_word, weights=classes.tables, minlength=len(words)), uniform)

    seat_above(np.ones(own.sum()), uniform[cell_word])
    leaves.settle(counts[own].astype(np.float64), seating.above(0, np.arange(own.sum())))
    seat_above(leaves.tables, root.chance(cell_word, seating.base))
    by_cell = np.argsort(of[own], kind="stable")  # all of a class cell, and so of a word, together
    for sweep in range(SWEEPS):
        seating.sweep(0, by_cell, cell_word[of[own][by_cell]])
        seating.sweep(1, np.arange(len(cells)), cell_word)
        seating.sweep(2, np.arange(len(words)), np.arange(len(words)))
        if sweep >= SWEEPS - SAMPLES:
            tables = np.zeros(len(keys))
            tables[own] = leaves.tables
            samples.append([x.copy() for x in (tables, classes.customers, classes.tables, root.customers, root.tables)])
    return [np.stack(x, 1).astype(np.int64) for x in zip(*samples, strict=True)], cells, words


#: Columns of a bucket's model; the first of each pair holds keys that ascend, the others numbers, by sample one after the other.
PARTS = {"keys": ("counts", "tables"), "cells": ("cell_customers", "cell_tables"), "words": ("word_counts", "customers", "seated")}
BLOBS = [x for k, others in PARTS.items() for x in (k, *others)]
_BLOB_COLUMNS = "n_keys long, n_cells long, n_words long, " + ", ".join(f"{x} binary" for x in BLOBS)
MODEL = f"bucket int, {_BLOB_COLUMNS}, sums array<double>, sizes array<long>"


def _blobs(values: dict[str, np.ndarray]) -> list[pa.Array]:
    sizes = [pa.array([len(values[k])], pa.int64()) for k in PARTS]
    return sizes + [pa.array([C.squeezed(np.asarray(values[x]).ravel(order="F"), x in PARTS)], pa.binary()) for x in BLOBS]


def _sample(parent: np.ndarray, context_totals: np.ndarray, n_words: int, discounts, seed: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b, n = batch.column("bucket")[i].as_py(), batch.column("n")[i].as_py()
                keys = C.unsqueezed(batch.column("keys")[i].as_py(), n, True)
                counts = C.unsqueezed(batch.column("counts")[i].as_py(), n).astype(np.int64)
                (tables, cell_customers, cell_tables, customers, seated), cells, words = gibbs(keys, counts, parent, context_totals, n_words, discounts, seed + b)
                of = np.searchsorted(words, keys & ~_LOW)
                total = np.bincount(of, weights=counts, minlength=len(words)).astype(np.int64)
                context, kind = (keys & _LOW).astype(np.int64), (cells & _LOW).astype(np.int64)
                sums = [np.bincount(context, weights=tables[:, s], minlength=len(parent)) for s in range(SAMPLES)]
                sums += [np.bincount(kind, weights=x[:, s], minlength=FIRST_WORD) for x in (cell_customers, cell_tables) for s in range(SAMPLES)]
                sums += [customers.sum(0), seated.sum(0)]
                sizes = np.bincount(_level(total), weights=np.bincount(of, minlength=len(words)), minlength=256).astype(np.int64)
                values = dict(zip(BLOBS, (keys, counts, tables, cells, cell_customers, cell_tables, words, total, customers, seated), strict=True))
                last = [pa.array([np.concatenate(sums).tolist()], pa.list_(pa.float64())), pa.array([sizes.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *_blobs(values), *last], [x.split()[0] for x in MODEL.split(", ")])

    return run


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, (6 * np.log2(np.maximum(counts, 1))).astype(np.int64))


class Predictor:
    """Average predictive probabilities of the words it holds; any other word is unknown to the training set."""

    def __init__(self, parts: list[dict[str, np.ndarray]], facts: dict):
        f = self.facts = facts
        x = {}
        for k, others in PARTS.items():
            joined = [np.concatenate([p[c] for p in parts]) if parts else np.empty((0,) if c in (k, "counts", "word_counts") else (0, SAMPLES)) for c in (k, *others)]
            order = np.argsort(joined[0].astype(np.uint64))
            x |= {c: v[order] for c, v in zip((k, *others), joined, strict=True)}
        self.words, self.total = x["words"].astype(np.uint64), x["word_counts"].astype(np.float64)
        d, d1, d0 = f["discounts"]
        root = (x["customers"] - d0 * x["seated"]) / (CONCENTRATION + f["customers"]) + f["unknown"]
        self.root = np.concatenate([root, f["unknown"][None]])  # the last is for unknown words
        self.cells = x["cells"].astype(np.uint64)
        kind = (self.cells & _LOW).astype(np.int64)
        self.own_cell = (x["cell_customers"] - d1 * x["cell_tables"]) / (CONCENTRATION + f["class_customers"])[kind]
        inside = (x["keys"].astype(np.uint64) & _LOW) >= np.uint64(FIRST_WORD)
        self.keys = x["keys"].astype(np.uint64)[inside]
        context = (self.keys & _LOW).astype(np.int64)
        self.own = (x["counts"][inside][:, None] - d * x["tables"][inside]) / (CONCENTRATION + f["contexts"])[context][:, None]

    @staticmethod
    def _found(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places, and the number of places for what isn't there."""
        at = np.searchsorted(sorted_, wanted)
        there = at < len(sorted_)
        there[there] = sorted_[at[there]] == wanted[there]
        return np.where(there, at, len(sorted_))

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the word is held, its count, and the probability. Keys are looked up once each, in order."""
        keys, of = np.unique(keys, return_inverse=True)
        f, context = self.facts, (keys & _LOW).astype(np.int64)
        kind = f["parent"][context]
        word = self._found(self.words, keys & ~_LOW)
        count = np.r_[self.total, 0][word]
        p = f["class_back"][kind] * self.root[word]
        cell = self._found(self.cells, (keys & ~_LOW) | kind.astype(np.uint64))
        some = np.flatnonzero(cell < len(self.cells))
        p[some] += self.own_cell[cell[some]]
        leaf = np.flatnonzero(context >= FIRST_WORD)
        p[leaf] *= f["back"][context[leaf]]
        pair = self._found(self.keys, keys[leaf])
        some = pair < len(self.keys)
        p[leaf[some]] += self.own[pair[some]]
        return (word < len(self.words))[of], count[of], p.mean(axis=1)[of]


def facts_of(parent: np.ndarray, contexts: np.ndarray, n_words: int, tokens: int, discounts, sums: np.ndarray) -> dict:
    """What all restaurants hold together, by sample. A restaurant's back is the weight of its parent in it."""
    n, s = len(parent), SAMPLES
    tables = sums[: n * s].reshape(s, n).T
    class_customers, class_tables = (sums[n * s + k * FIRST_WORD * s :][: FIRST_WORD * s].reshape(s, FIRST_WORD).T for k in (0, 1))
    customers, seated = sums[-2 * s : -s], sums[-s:]
    d, d1, d0 = discounts
    return {
        "parent": parent, "discounts": discounts, "words": n_words, "tokens": tokens, "contexts": contexts, "customers": customers, "class_customers": class_customers,
        "back": (CONCENTRATION + d * tables) / (CONCENTRATION + contexts)[:, None], "class_back": (CONCENTRATION + d1 * class_tables) / (CONCENTRATION + class_customers),
        "unknown": (CONCENTRATION + d0 * seated) / (CONCENTRATION + customers) / (n_words + 1),
    }


def _parts(rows: list[dict]) -> list[dict[str, np.ndarray]]:
    out = []
    for r in rows:
        part = {}
        for k, others in PARTS.items():
            n = r[f"n_{k}"]
            part[k] = C.unsqueezed(bytes(r[k]), n, True)
            for x in others:
                many = x not in ("counts", "word_counts")
                v = C.unsqueezed(bytes(r[x]), n * SAMPLES if many else n).astype(np.float64)
                part[x] = v.reshape(SAMPLES, n).T if many else v
        out.append(part)
    return out


def _head(level: int):
    """Of each bucket, the words of that level of counts or more."""

    def run(batches):
        names = [x.split()[0] for x in _BLOB_COLUMNS.split(", ")]
        for batch in batches:
            for r in batch.select(names).to_pylist():
                (part,) = _parts([r])
                top = _level(part["word_counts"]) >= level
                keep = {"words": top} | {k: top[np.searchsorted(part["words"], part[k] & ~_LOW)] for k in ("keys", "cells")}
                values = {x: part[x][keep[k]] for k, others in PARTS.items() for x in (k, *others)}
                yield pa.RecordBatch.from_arrays(_blobs(values), names)

    return run


def _sums(doc: np.ndarray, n: int, count: np.ndarray, p: np.ndarray, facts: dict) -> np.ndarray:
    """For each text: known tokens, base score, score."""
    base = np.log10((count + 0.1) / (facts["tokens"] + 0.1 * (facts["words"] + 1)))
    return np.stack([np.bincount(doc, weights=w, minlength=n) for w in ((count > 0).astype(float), base, np.log10(p))], 1)


TOKENS = "bucket int, chunk long, ids binary, sums binary, n long, keys binary, counts binary"
_TOKENS = [x.split()[0] for x in TOKENS.split(", ")]


def _split(head, contexts: Contexts, facts: dict, n: int):
    """For each chunk of texts, a row with ids and what the head scores, and the other tokens packed by bucket, with their texts."""
    state: list = []

    def run(batches):
        if not state:
            state.append(Predictor(_parts(head.value), facts))
        predictor, k = state[0], 0
        for batch in batches:
            for ids, texts in C.text_chunks(batch, 4_000_000):
                chunk = (TaskContext.get().partitionId() << 32) + k
                k += 1
                keys, counts = contexts.keys(texts)
                doc = np.repeat(np.arange(len(ids)), counts)
                known, count, p = predictor(keys)
                sums = np.column_stack([counts.astype(float), _sums(doc[known], len(ids), count[known], p[known], facts)])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as w:
                    w.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["id"]))
                main = [pa.array([-1 - chunk % n], pa.int32()), pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*main, pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], _TOKENS)
                rest = np.flatnonzero(~known)
                if len(rest):
                    rest = rest[np.argsort(keys[rest], kind="stable")]
                    b = _packed(bucket_of(keys[rest], n), keys[rest], doc[rest])
                    m = b.num_rows
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([chunk] * m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), b.column(1), b.column(2), b.column(3)], _TOKENS)

    return run


PARTIAL = "chunk long, ids binary, docs binary, sums binary"
_PARTIAL = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("docs", pa.binary()), ("sums", pa.binary())])


def _score(facts: dict):
    def run(key, tokens: pa.Table, model: pa.Table) -> pa.Table:
        if not len(tokens):
            return _PARTIAL.empty_table()
        if key[0].as_py() < 0:
            return pa.table([tokens.column("chunk"), tokens.column("ids"), pa.nulls(len(tokens), pa.binary()), tokens.column("sums")], schema=_PARTIAL)
        predictor = Predictor(_parts(model.to_pylist()), facts)
        docs, sums = [], []
        for i in range(len(tokens)):
            n = tokens.column("n")[i].as_py()
            keys, doc = C.unsqueezed(tokens.column("keys")[i].as_py(), n, True), C.unsqueezed(tokens.column("counts")[i].as_py(), n)
            _, count, p = predictor(keys)
            some, of = np.unique(doc, return_inverse=True)
            docs.append(some.astype(np.uint32).tobytes())
            sums.append(_sums(of, len(some), count, p, facts).tobytes())
        return pa.table([tokens.column("chunk"), pa.nulls(len(tokens), pa.binary()), pa.array(docs, pa.binary()), pa.array(sums, pa.binary())], schema=_PARTIAL)

    return run


def _join(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    main = next(r for r in rows if r["ids"] is not None)
    ids = pa.ipc.open_stream(main["ids"]).read_all().column("id")
    total = np.frombuffer(main["sums"], np.float64).reshape(-1, 4).copy()
    for r in rows:
        if r["docs"] is not None:
            total[np.frombuffer(r["docs"], np.uint32), 1:] += np.frombuffer(r["sums"], np.float64).reshape(-1, 3)
    return pa.table({"doc_id": ids, "n_tokens": pa.array(total[:, 0].astype(np.int64)), "n_known": pa.array(np.rint(total[:, 1]).astype(np.int64)), "base_score": pa.array(total[:, 2]), "score": pa.array(total[:, 3])})


def bucket_count(*tables: DataFrame) -> int:
    """Buckets follow the larger table's characters alone, so scores don't change with the session's partitions."""
    characters = max(t.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0 for t in tables)
    return max(BUCKETS, math.ceil(characters / BUCKET_CHARACTERS))


def score_texts(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs, by a model learned from all rows of train."""
    spark = docs.sparkSession
    train = C.id_and_text(train, id_col, text_col)
    n = bucket_count(train, C.id_and_text(docs, id_col, text_col))
    contexts = frequent_contexts(train, n)
    parent = contexts.parent
    counted = train.mapInArrow(_count(lambda texts: contexts.keys(texts)[0], n), PACKED)
    merged = C.checkpoint(counted.groupBy("bucket").applyInArrow(_merge(parent), MERGED))
    known = _totals(merged, "facts", n) or [0] * (8 + len(parent))
    n_words, tokens, *levels = known[:8]
    totals = np.array(known[8:], np.float64)
    discounts = tuple(min(0.95, max(0.05, a / max(1, a + 2 * b))) for a, b in zip(levels[::2], levels[1::2], strict=True))
    model = C.checkpoint(merged.drop("facts").mapInArrow(_sample(parent, totals, n_words, discounts, seed), MODEL))
    sums = np.array(_totals(model, "sums", n) or [0.0] * (SAMPLES * (len(parent) + 2 * FIRST_WORD + 2)))
    facts = facts_of(parent, totals, n_words, tokens, discounts, sums)
    pairs = np.array(_totals(model, "sizes", n) or [0] * 256)
    above = np.cumsum(pairs[::-1])[::-1]
    level = int(np.argmax(above <= HEAD_PAIRS)) if (above <= HEAD_PAIRS).any() else 256
    top = model.mapInArrow(_head(level), _BLOB_COLUMNS).collect()
    head = spark.sparkContext.broadcast([r.asDict() for r in top])
    split = C.id_and_text(docs, id_col, text_col).mapInArrow(_split(head, contexts, facts, n), TOKENS)
    partial = split.groupBy("bucket").cogroup(model.drop("sums", "sizes").groupBy("bucket")).applyInArrow(_score(facts), PARTIAL)
    result = partial.groupBy("chunk").applyInArrow(_join, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return result.withColumn("train_tokens", F.lit(int(tokens)).cast("long"))


def op9_pitman_yor(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    held_out = F.coalesce(C.fold_column(F.col("doc_id"), 10) == 0, F.lit(False))
    scored = score_texts(docs, docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Quality of texts by a vote of their nearest labelled neighbours among latent-semantic vectors.

Terms are hashed words and hashed shapes of words (case, digits, symbols, punctuation, length, equality with the word before) with pairs
of shapes. The latent space is the truncated singular value decomposition of the log tf-idf of SAMPLE labelled rows at most (those of
the smallest hash of the id, whole texts); it and their vectors are broadcast, which is SAMPLE x RANK numbers whatever the input. Terms of
the sample are counted by the executors. Every text is compared with all of them in blocks of exact cosine products, and its NEIGHBOURS
nearest vote for their labels with the fourth power of their similarity; of neighbours that are equally near (to six digits) those with
the smaller hash of the id count. A text without words, or without a similar neighbour, scores the share of label 1 in the sample.

Null labels and labelled texts without words are not learned from; of several rows of an id each may be learned from, of several labels
the largest counts. Without any label all texts score 0.5. An empty table gives an empty result. Repeated rows have equal scores; a null id
is not held out. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm import common as C

SAMPLE, RANK, NEIGHBOURS = 4000, 64, 25
#: Rows of a batch that are looked at together.
SLICE = 512
WORDS, SHAPES = 2048, 2048
TERMS = WORDS + SHAPES
CUT = 0.3

_CLASS = np.zeros(256, np.int64)
for _chars, _k in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), ("#*$%&|<>", 3), ("!?", 4), (".,;:", 5)):
    for _c in _chars:
        _CLASS[ord(_c)] = _k


def _shapes(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case hash and shape of each word."""
    h, starts, ends = C._hash_words(b, True)
    n = ends - starts
    kind = _CLASS[np.frombuffer(b, np.uint8)]
    parts = []
    for k in range(1, 6):
        total = np.r_[0, np.cumsum(kind == k)]
        parts.append(total[ends] - total[starts])
    upper, digit, symbol, mark, stop = parts
    rest = n - digit - symbol - mark - stop
    case = np.where(upper == 0, 0, np.where((upper >= rest) & (n > 1), 2, 1))
    shape = case
    for x, m in ((np.minimum(digit, 2), 3), (np.minimum(symbol, 2), 3), (np.minimum(mark, 2), 3), (np.minimum(stop, 1), 2), (np.minimum(n // 4, 4), 5)):
        shape = shape * m + x
    again = np.r_[False, h[1:] == h[:-1]]
    return h, shape * 2 + again


#: Bytes of a text that are looked at together; a cut falls between words.
PIECE = 1 << 20


def terms(texts: list[str | None]) -> np.ndarray:
    """Counts of terms, a row for each text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, t in enumerate(texts):
        b, at = (t or "").encode(), 0
        last_word, last_shape = None, None
        while at < len(b):
            cut = C.SEPARATOR.search(b, at + PIECE) if len(b) - at > PIECE else None
            end = cut.start() if cut else len(b)
            h, shape = _shapes(b[at:end])
            at = end
            if not len(h):
                continue
            if last_word is not None:  # as if there were no cut
                shape[0] += last_word == h[0]
                before = np.r_[last_shape, shape[:-1]]
            else:
                before = shape[:-1]
            pair = C.mix((shape[len(shape) - len(before) :] * 4099 + before).astype(np.uint64)) % np.uint64(SHAPES)
            one = C.mix(shape.astype(np.uint64) + np.uint64(77)) % np.uint64(SHAPES)
            all_terms = np.concatenate([(h % np.uint64(WORDS)).astype(np.int64), WORDS + one.astype(np.int64), WORDS + pair.astype(np.int64)])
            out[i] += np.bincount(all_terms, minlength=TERMS)
            last_word, last_shape = h[-1], shape[-1]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS):
        """counts: the terms of labelled texts, a row each."""
        some = counts.sum(axis=1) > 0
        counts, self.labels = counts if some.all() else counts[some], np.asarray(labels, np.float64)[some]
        self.prior, self.neighbours = (float(self.labels.mean()) if len(self.labels) else 0.5), neighbours
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
        weighed = self._weigh(counts)
        k = min(rank, *weighed.shape) if len(weighed) else 0
        rng = np.random.default_rng(3)
        q = weighed.T @ rng.standard_normal((len(weighed), k + 8)).astype(np.float32) if k else np.zeros((TERMS, 0), np.float32)
        for _ in range(4 if k else 0):  # subspace iteration
            q = np.linalg.qr(weighed.T @ (weighed @ q))[0]
        if k:
            _, _, v = np.linalg.svd(weighed @ q, full_matrices=False)
            self.space = (q @ v[:k].T).astype(np.float32)
        else:
            self.space = q
        self.vectors = _unit(weighed @ self.space).astype(np.float32)

    def _weigh(self, counts: np.ndarray) -> np.ndarray:
        out = np.empty(counts.shape, np.float32)
        for at in range(0, len(counts), 256):  # the driver holds the counts and the result, no more
            x = np.log1p(counts[at : at + 256]) * self.idf
            out[at : at + 256, :WORDS] = 0.3 * _unit(x[:, :WORDS])
            out[at : at + 256, WORDS:] = _unit(x[:, WORDS:])
        return out

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        k = min(self.neighbours, len(self.labels))
        near = np.rint((vectors @ self.vectors.T) * 1e6)  # whole numbers: ties are ties
        least = np.partition(near, near.shape[1] - k, axis=1)[:, -k][:, None]
        above, equal = near > least, near == least
        chosen = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        weight = np.where(chosen, np.maximum(near * 1e-6, 0).astype(np.float64) ** 4, 0)
        total = weight.sum(axis=1)
        return np.where(total > 1e-9, (weight @ self.labels) / np.maximum(total, 1e-9), self.prior)

    def score(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        for at in range(0, len(texts) if len(self.labels) else 0, block):
            out[at : at + block] = self.vote(_unit(self._weigh(terms(texts[at : at + block])) @ self.space))
        return np.clip(out, 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, facts, label: str = "quality", folds: int = 5, most: int = SAMPLE) -> list[tuple[bytes, int]]:
    """Facts and label of `most` labelled rows whose fold is not 0: those with the smallest hash of the id. `facts` gives the bytes that
    are learned from, from a whole text; it runs on the executors, so that no text comes to the driver."""
    named = labels.select(labels["doc_id"].cast("long").alias("labelled"), labels[label].cast("int").alias("label")).where("label is not null")
    named = named.where(C.fold_column(F.col("labelled"), folds) != 0)
    chosen = named.groupBy("labelled").agg(F.max("label").alias("label")).orderBy(F.xxhash64("labelled"), "labelled").limit(most)
    texts = C.id_and_text(docs)
    texts = texts.join(F.broadcast(chosen), texts.doc_id == chosen.labelled).select("doc_id", "label", "text")

    def run(batches):
        for batch in batches:
            hashes = [zlib.crc32((t.as_py() or "").encode()) for t in batch.column("text")]
            found = [facts(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "label", "check", "facts"])

    rows = texts.mapInArrow(run, "doc_id long, label int, check long, facts binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "check", "facts").limit(most).collect()
    return [(bytes(r["facts"]), int(r["label"] > 0)) for r in rows]


def _sparse(text: str | None) -> bytes:
    row = terms([text])[0]
    at = np.flatnonzero(row)
    return at.astype(np.uint16).tobytes() + row[at].astype(np.float32).tobytes()


def _dense(facts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(facts), TERMS), np.float32)
    for i, x in enumerate(facts):
        n = len(x) // 6
        out[i, np.frombuffer(x, np.uint16, n)] = np.frombuffer(x, np.float32, n, 2 * n)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5) -> Model:
    sample = labelled_sample(docs, labels, _sparse, label, folds)
    return Model(_dense([x for x, _ in sample]), np.array([y for _, y in sample]))


def _scored(model, cut: float):
    def run(batches):
        for batch in batches:
            scores = np.concatenate([model.value.score(texts) for _, texts in C.text_chunks(batch)]) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, score, predicted for each row."""
    book = docs.sparkSession.sparkContext.broadcast(model)
    return C.id_and_text(docs).mapInArrow(_scored(book, cut), "doc_id long, score double, predicted int")


def keep_quality(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, that score `cut` or more."""
    book = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield part.filter(pa.array(book.value.score(part.column("text").to_pylist()) >= cut))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_knn(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    scored = score_quality(docs, fit(docs, C.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(C.fold_column(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")

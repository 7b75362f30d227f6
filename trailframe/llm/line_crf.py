"""Content and boilerplate lines by a linear-chain conditional random field, and quality rules over a text.

Each line with a word has yes-or-no features (length, symbols, separators, capitals, digits, repetition inside the line and of earlier
lines, place); two states, content and boilerplate; weights of features and transitions are learned by gradient ascent on the
likelihood of sequences. Training takes SAMPLE labelled rows at most, with all lines of their texts, in windows of WINDOW lines (lines know
their place in the whole text; only the transition from one window to the next is not learned from): lines of good texts are content;
lines of bad texts start as boilerplate and are labelled again once by the model that this gives. Viterbi decoding labels all lines of
every text, and a text is kept when content lines hold CONTENT_SHARE of the characters of its words. Without two kinds of labels the prior
weights in PRIOR decide.

Of paths that score alike the one with content in the later line counts. Null and empty texts have no words and fail the base rules; an
empty table gives an empty result. Repeated rows have equal results; null ids are kept. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm import common as C
from trailframe.llm.quality_knn import labelled_sample

SAMPLE, WINDOW, STEPS = 1500, 48, 80
CONTENT_SHARE = 0.5
FEATURES = ("bias", "one word", "2 to 5 words", "6 to 20 words", "over 20 words", "symbols over 3 %", "symbols over 10 %", "words ending in symbols over half", "bars among words", "capitals over half", "marks on words over half", "digits over 20 %", "distinct words below 60 %", "distinct words below 25 %", "equal to an earlier line", "ends with a stop", "long words", "first", "last")
#: Weight of boilerplate for each feature, where nothing can be learned.
PRIOR = np.array([-2.0, 0, 0, 0, 0, 2, 2, 2, 2, 2, 2, 1, 1, 2, 2, -0.5, 0, 0, 0])
SYMBOL = re.compile(r"[#*$%&|<>]")


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines that have a word, and the characters of their words."""
    rows, weight, seen = [], [], set()
    for line in lines:
        words = C.WORD.findall(line)
        if not words:
            continue
        n, chars = len(words), sum(map(len, words))
        symbols = len(SYMBOL.findall(line))
        few = symbols > 0
        ends = sum(w[-1] in "#*$%&|<>" for w in words) if few else 0
        bars = words.count("|") if few else 0
        upper = line.isupper() or (not line.islower() and sum(map(str.isupper, line)) > 0.5 * chars)
        digits = sum(map(str.isdigit, line)) if not line.isalpha() else 0
        marks = line.count("!") + line.count("?")
        distinct = len(set(words)) / n if n > 4 else 1.0
        rows.append((1, n == 1, 2 <= n <= 5, 6 <= n <= 20, n > 20, symbols > 0.03 * chars, symbols > 0.1 * chars, ends > n / 2, bars > 0, upper, marks > n / 2, digits > 0.2 * chars, distinct < 0.6, distinct < 0.25, line in seen, line.rstrip().endswith((".", "!", "?")), chars > 9 * n, not rows, 0))
        seen.add(line)
        weight.append(chars)
    x = np.array(rows, np.float64).reshape(-1, len(FEATURES))
    if len(x):
        x[-1, -1] = 1
    return x, np.array(weight, np.float64)


class Crf:
    """State 1 is boilerplate; a line's score for it is its features times `weights`, state 0 scores 0; move[i, j] is a transition's."""

    def __init__(self, weights: np.ndarray = PRIOR, move: np.ndarray | None = None):
        self.weights, self.move = weights.copy(), np.array([[0.5, -0.5], [-0.5, 0.5]]) if move is None else move.copy()

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        score = (x @ self.weights).tolist()
        (aa, ab), (ba, bb) = self.move.tolist()
        a, b, back = 0.0, score[0] if score else 0.0, []
        for s in score[1:]:
            from_a, from_b = a + aa >= b + ba, a + ab >= b + bb
            back.append((from_a, from_b))
            a, b = (a + aa if from_a else b + ba), (a + ab if from_b else b + bb) + s
        out = [int(b > a)]
        for from_a, from_b in reversed(back):
            out.append(0 if (from_b if out[-1] else from_a) else 1)
        return np.array(out[::-1][: len(score)], np.int64)

    def likelihood(self, sequences: list[tuple[np.ndarray, np.ndarray]]):
        """A function of theta (weights, then transitions) that gives the mean log-likelihood of the states and its gradient, forward and
        backward over all sequences at once."""
        n, longest, width = len(sequences), max(len(x) for x, _ in sequences), len(self.weights)
        xs, ys = np.zeros((n, longest, width), np.float32), np.zeros((n, longest), np.int64)
        mask = np.zeros((n, longest), bool)
        for i, (x, y) in enumerate(sequences):
            xs[i, : len(x)], ys[i, : len(x)], mask[i, : len(x)] = x, y, True
        both = mask[:, 1:] & mask[:, :-1]
        seen = np.array([[((ys[:, :-1] == i) & (ys[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)], float)
        told = np.einsum("nt,ntf->f", (ys * mask).astype(np.float64), xs)
        total = mask.sum()

        def value(theta: np.ndarray) -> tuple[float, np.ndarray]:
            w, move = theta[:width], theta[width:].reshape(2, 2)
            local = np.stack([np.zeros((n, longest)), xs @ w], 2) * mask[:, :, None]
            forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
            forward[:, 0] = local[:, 0]
            for t in range(1, longest):
                step = np.logaddexp(forward[:, t - 1, :1] + move[0], forward[:, t - 1, 1:] + move[1]) + local[:, t]
                forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                after = local[:, t + 1] + backward[:, t + 1]
                step = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
                backward[:, t] = np.where(mask[:, t + 1, None], step, 0)
            z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
            state = np.exp(forward + backward - z[:, None, None])[:, :, 1] * mask
            pair = np.exp(forward[:, :-1, :, None] + move + (local[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
            slope = np.r_[told - np.einsum("nt,ntf->f", state, xs), (seen - pair.sum(axis=(0, 1))).ravel()]
            return float(told @ w + (seen * move).sum() - z.sum()) / total, slope / total

        return value

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, rate: float = 0.1) -> None:
        """Gradient ascent (Adam) on the mean log-likelihood, with a small penalty of squares."""
        value = self.likelihood(sequences)
        theta = np.r_[self.weights, self.move.ravel()]
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            slope = value(theta)[1] - 1e-4 * theta
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        self.weights, self.move = theta[:-4], theta[-4:].reshape(2, 2)


def packed_lines(text: str | None) -> bytes:
    """The features of all lines of a text, a bit each."""
    return np.packbits(line_features((text or "").split("\n"))[0].astype(bool), axis=1).tobytes()


def unpacked_lines(facts: bytes) -> np.ndarray:
    width = -(-len(FEATURES) // 8)
    return np.unpackbits(np.frombuffer(facts, np.uint8).reshape(-1, width), axis=1)[:, : len(FEATURES)].astype(np.float64)


def train(sample: list[tuple[bytes, int]], window: int = WINDOW) -> Crf:
    """A model of the packed lines of labelled texts (1: good)."""
    crf = Crf()
    parts = [(x, y) for x, y in ((unpacked_lines(f), y) for f, y in sample) if len(x)]
    if len({y for _, y in parts}) < 2:
        return crf

    def windows(labelled):
        return [(x[s : s + window], y[s : s + window]) for x, y in labelled for s in range(0, len(x), window)]

    crf.fit(windows((x, np.full(len(x), 1 - y)) for x, y in parts))
    crf.fit(windows((x, np.zeros(len(x), np.int64) if y else crf.viterbi(x)) for x, y in parts))
    return crf


def repeated_words(h: np.ndarray, width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    if len(h) <= width:
        return 0
    rolled = np.zeros(len(h) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            rolled = rolled * np.uint64(0x9FB21C651E98DF25) + h[k : k + len(rolled)]
    order = np.sort(rolled)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(rolled, twice)
    change = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"


def judge(texts: list[str | None], crf: Crf, share: float = CONTENT_SHARE) -> list[tuple]:
    h, counts = C.word_hashes(texts, lower=False)
    ends = np.cumsum(counts)
    out = []
    for t, e, n in zip(texts, ends.tolist(), counts.tolist(), strict=True):
        lines = (t or "").split("\n")
        x, chars = line_features(lines)
        state = crf.viterbi(x)
        seen, dup = set(), 0
        if len(x) > 1:
            for line in lines:
                if line in seen:
                    dup += C.WORD.search(line) is not None
                else:
                    seen.add(line)
        repeat = repeated_words(h[e - n : e])
        content = float(chars[state == 0].sum() / chars.sum()) if len(x) else 0.0
        failed = n < 10 or 100 * repeat > 20 * n
        out.append((n, int(chars.sum()), len(SYMBOL.findall(t or "")), dup, repeat, failed, not failed and content >= share, content, len(x), int((state == 0).sum())))
    return out


def _judged(crf: Crf, share: float):
    def run(batches):
        for batch in batches:
            rows = [r for _, texts in C.text_chunks(batch) for r in judge(texts, crf, share)]
            names = [x.split() for x in RESULT.split(", ")]
            types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(names[1:]))], [n for n, _ in names])

    return run


def _labelled_lines(crf: Crf):
    def run(batches):
        for batch in batches:
            out = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = [(k, line) for k, line in enumerate((t or "").split("\n")) if C.WORD.search(line)]
                state = crf.viterbi(line_features([line for _, line in lines])[0])
                out += [(i, k, line, "boilerplate" if s else "content") for (k, line), s in zip(lines, state, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "line", "text", "state"])

    return run


def judge_documents(docs: DataFrame, crf: Crf, share: float = CONTENT_SHARE) -> DataFrame:
    """The base counts, base_failed, kept, content_share, n_lines and n_content_lines of each row."""
    return C.id_and_text(docs).mapInArrow(_judged(crf, share), RESULT)


def label_lines(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, line, text, state of each line with a word."""
    return C.id_and_text(docs).mapInArrow(_labelled_lines(crf), "doc_id long, line long, text string, state string")


def op1_line_crf(spark, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return judge_documents(docs, train(labelled_sample(docs, C.read(spark, sf_dir, "labels"), packed_lines, most=SAMPLE)))

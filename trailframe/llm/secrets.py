"""Secrets in texts: three patterns, and strings that a tokenizer finds hard.

Base kinds are assign, access and hex (see ASSIGN, ACCESS, HEX). The token-efficiency test adds `random`: words of FLOOR or more
characters of the usual alphabets of keys that a public byte-pair vocabulary needs many tokens for - less than RATIO characters a token.
Words shorter than LONG must also have a stretch of 8 characters or more, without hyphens and underlines, that mixes letters with digits, or
has capitals inside: the ratio alone is as low for some rare words of prose, and for times and names of several parts. Known digests (hex of a digest's length) and identifiers (UUIDs, numbers) are left out, and
so are words that lie within one base span.

Null and empty texts have no spans; an empty table gives an empty result. Offsets count code points, ends are exclusive. Spans that start
at one place come in the order of kinds. Repeated rows have equal results; null ids are kept. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm import common as C

#: Fixed values of the query's contract.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

RATIO, FLOOR, LONG = 2.0, 12, 20
#: Rows of a batch that are looked at together.
SLICE = 512
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
STRETCH = re.compile(r"[A-Za-z0-9+/=]{8,}")
MIXED = re.compile(r"\d.*[A-Za-z]|[A-Za-z].*\d|[a-z][A-Z]|[A-Z]{2}[a-z]")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
IDENTIFIER = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[\d_+=/-]+", re.I)
RESULT = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, encoding, base: list[tuple[int, int, int]], ratio: float = RATIO, floor: int = FLOOR) -> list[tuple[int, int, int]]:
    if not any(len(w) >= floor for w in text.split()):
        return []
    out = []
    for m in re.finditer(CANDIDATE % floor, text):
        word = m[0]
        if len(word) < LONG and not any(MIXED.search(s) for s in STRETCH.findall(word)):
            continue
        if DIGEST.fullmatch(word) or IDENTIFIER.fullmatch(word) or any(s <= m.start() and m.end() <= e for s, _, e in base):
            continue
        if len(word) < ratio * len(encoding.encode_ordinary(word)):
            out.append((m.start(), 3, m.end()))
    return out


def scan_text(text: str | None, encoding, ratio: float = RATIO) -> tuple[list, list]:
    """Base spans, and all spans, as (start, kind, end) in order of start and kind."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + random_spans(text, encoding, base, ratio))


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str | None, spans: list, mark: str = "[SECRET]") -> str | None:
    """The text with a mark for each run of spans that overlap."""
    if not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _scan(vocabulary, ratio: float):
    state: list = []

    def run(batches):
        if not state:
            state.append(C.load_encoding(vocabulary.value))
        for batch in batches:
            rows = []
            for _, texts in C.text_chunks(batch):
                for t in texts:
                    base, spans = scan_text(t, state[0], ratio)
                    kinds = [k for _, k, _ in spans]
                    rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(x.split()[0] for x in RESULT.split(", "))])

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = C.VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for each row."""
    book = C.broadcast_vocabulary(docs.sparkSession, vocabulary)
    return C.id_and_text(docs, id_col, text_col).mapInArrow(_scan(book, ratio), "doc_id long, " + RESULT)


def redact_secrets(docs: DataFrame, vocabulary: str = C.VOCABULARY, ratio: float = RATIO, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs, with secrets in `text` replaced by a mark and n_chars (where there is such a column) counted anew
    for the texts that changed."""
    book = C.broadcast_vocabulary(docs.sparkSession, vocabulary)
    state: list = []

    def run(batches):
        if not state:
            state.append(C.load_encoding(book.value))
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = batch.column("text").to_pylist()
                clean = [redact(t, scan_text(t, state[0], ratio)[1], mark) for t in texts]
                columns = []
                for name, column in zip(batch.schema.names, batch.columns, strict=True):
                    if name == "text":
                        column = pa.array(clean, column.type)
                    elif name == "n_chars":
                        column = pa.array([n if c is None or c == t else len(c) for n, c, t in zip(column.to_pylist(), clean, texts, strict=True)], column.type)
                    columns.append(column)
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(C.read(spark, sf_dir, "documents"))

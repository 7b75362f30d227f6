"""What the operators on text share: words, packed rows, checkpoints, bit filters."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.sources.shared import settled

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: A public byte-pair vocabulary, and the pieces that its tokens stay in.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def load_encoding(vocabulary: bytes):
    """The tokenizer of a vocabulary file's bytes."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def broadcast_vocabulary(spark: SparkSession, path: str):
    """The file's bytes, read once on the driver; a vocabulary has some tens of thousands of lines."""
    return spark.sparkContext.broadcast(open(path, "rb").read())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns the operators read, under fixed names, so that no other column can clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def words(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def lower_words(text: str | None) -> list[str]:
    """Words with A-Z in lower case; other letters stay."""
    if not text:
        return []
    return WORD.findall(text.lower() if text.isascii() else text.translate(LOWER))


def fold(doc_id: int | None, n: int) -> int | None:
    """crc32 of the id as text, modulo n; a null id has no fold."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def fold_column(col, n: int):
    return F.crc32(col.cast("string").cast("binary")) % n


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows written to the folder in spark.checkpoint.dir, which all executors share; they go when nothing refers to them any more."""
    return settled(df)


def bucket_count(spark: SparkSession, times: int = 4) -> int:
    """Buckets of a packed shuffle: a multiple of the session's shuffle partitions, which follow the input."""
    return max(8, times * int(spark.conf.get("spark.sql.shuffle.partitions")))


def string_hashes(values: Iterable[str], memo: dict[str, int] | None = None) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    if memo is None:
        return np.fromiter((h(v) for v in values), np.uint64)
    out = []
    for v in values:
        x = memo.get(v)
        if x is None:
            x = memo[v] = h(v)
        out.append(x)
    return np.array(out, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def packed(buckets: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch | None:
    """One row for each bucket, with that bucket's values of every column as bytes."""
    if not len(buckets):
        return None
    order = np.argsort(buckets, kind="stable")
    b = buckets[order]
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    ends = np.r_[starts[1:], len(b)]
    arrays = [pa.array(b[starts].astype(np.int32))]
    for c in columns:
        c = np.ascontiguousarray(c[order])
        arrays.append(pa.array([c[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *names])


def unpacked(table: pa.Table, name: str, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def squeezed(x: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers in few bytes: differences if they are `ascending`, then byte by byte, compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    if ascending and len(x):
        x = np.r_[x[:1], np.diff(x)]
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unsqueezed(data: bytes, n: int, ascending: bool = False) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    x = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x


def text_chunks(batch: pa.RecordBatch, most: int = 2_000_000, name: str = "doc_id") -> Iterator[tuple[list, list]]:
    """Lists of ids and texts of a batch, each of about `most` characters at most, or one longer text."""
    ids, texts, n = [], [], 0
    for i, t in zip(batch.column(name).to_pylist(), batch.column("text"), strict=True):
        t = t.as_py()
        if ids and n + len(t or "") > most:
            yield ids, texts
            ids, texts, n = [], [], 0
        ids.append(i)
        texts.append(t)
        n += len(t or "")
    if ids:
        yield ids, texts


#: Bits of a filter that marks rows, as a power of two: 1 MB, and up to 16 MB where more are marked.
FILTER_WIDTH, WIDEST_FILTER = 23, 27


def bit_hash(ids: np.ndarray) -> np.ndarray:
    """The hash whose first bits are an id's place in a filter of any width."""
    return mix(ids.astype(np.int64).view(np.uint64)).view(np.int64)


def _filter(ids: DataFrame, width: int) -> np.ndarray:
    place = f"shiftrightunsigned(bit, {64 - width}) + 1"  # buckets and bits count from 1
    found = ids.groupBy(F.expr(f"bitmap_bucket_number({place})").alias("b")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({place}))").alias("m")).collect()
    out = np.zeros(max(1 << width, 32768) >> 3, np.uint8)
    for r in found:
        part = np.frombuffer(bytes(r["m"]), np.uint8)
        at = (r["b"] - 1) * 4096
        out[at : at + len(part)] |= part
    return out[: 1 << width >> 3]


def marked(ids: DataFrame, width: int = FILTER_WIDTH, widest: int = WIDEST_FILTER) -> np.ndarray:
    """A filter of the ids whose hashes are in column `bit`, as bytes. If more than an eighth of its bits are set it is made again, so
    wide that about an eighth will be, `widest` at most; that much reaches the driver and each task. It may mark other rows too, so what
    is marked must be joined with the ids; where even the widest one fills up, that join is over all rows."""
    out = _filter(ids, width)
    share = np.bitwise_count(out).sum() / (8 * len(out))
    if share <= 1 / 8 or width >= widest:
        return out
    distinct = -np.log1p(-share) * 8 * len(out) if share < 1 else np.inf
    return _filter(ids, min(widest, int(np.ceil(np.log2(8 * distinct))))) if share < 1 else _filter(ids, widest)


def without_keys(docs: DataFrame, key: str, dropped: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose `key` (a long) isn't among `dropped`; of rows whose key is among `once` a single one: the first by all its
    other values. Both have a column of that name. Only rows that a bit filter marks are shuffled; the others are passed on in place."""
    touched = dropped.select(key) if once is None else dropped.select(key).unionByName(once.select(key))

    def bits(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bit_hash(batch.column(0).to_numpy(zero_copy_only=False)))], ["bit"])

    flags = marked(touched.mapInArrow(bits, "bit long"))
    at = docs.columns.index(key)

    def split(wanted: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(is_marked(flags, batch.column(at).to_numpy(zero_copy_only=False)) == wanted))

        return docs.mapInArrow(run, docs.schema)

    rest = split(True).join(dropped.select(key).distinct(), key, "left_anti")
    if once is not None:
        single = once.select(key).distinct()
        others = [F.col(c) for c, t in docs.dtypes if c != key and not t.startswith(("map", "variant"))]
        first = Window.partitionBy(key).orderBy(*(others or [F.col(key)]))
        alone = rest.join(single, key, "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        rest = rest.join(single, key, "left_anti").unionByName(alone)
    return split(False).unionByName(rest.select(*docs.columns))


def is_marked(filter_bytes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    width = len(filter_bytes).bit_length() + 2
    bit = (bit_hash(ids).view(np.uint64) >> np.uint64(64 - width)).astype(np.int64)
    return (filter_bytes[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


_B = 0x9E3779B97F4A7C15
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but letters and digits.
_NO_LETTER = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])
_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[65:91] += 32
SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_B, pow(_B, -1, 1 << 64)):
            p = np.full(max(n, 1 << 20), base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def _hash_words(joined: bytes, lower: bool, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of the bytes."""
    buf = np.frombuffer(joined, np.uint8)
    if lower:
        buf = _LOWER_BYTES[buf]
    gap = np.r_[True, (_NO_LETTER if letters else _SEPARATOR)[buf], True]
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = turns[::2], turns[1::2]
    pw, inv = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * pw[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, ends


def word_hashes(texts: list[str | None], lower: bool = True, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and how many words each text has. Words are the same as those
    of `words`, with A-Z lower-cased if `lower`; with `letters`, all ASCII but letters and digits stands between words."""
    h, _, counts = word_hashes_and_ends(texts, lower, letters)
    return h, counts


def word_hashes_and_ends(texts: list[str | None], lower: bool = True, letters: bool = False, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, with the last two bytes of each word. All work is on arrays over pieces of about `most` bytes, cut between words."""
    out, last, counts = [], [], np.zeros(len(texts), np.int64)
    pending: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        nonlocal size
        if not pending:
            return
        joined = b" ".join(b for _, b in pending)
        h, starts, ends = _hash_words(joined, lower, letters)
        buf = np.frombuffer(joined, np.uint8)
        buf = (_LOWER_BYTES[buf] if lower else buf).astype(np.uint16)
        last.append(buf[ends - 1] + 256 * np.where(ends - starts > 1, buf[ends - 2], 0).astype(np.uint16))
        bounds = np.cumsum([len(b) + 1 for _, b in pending])
        cut = np.searchsorted(starts, bounds)
        for (i, _), n in zip(pending, np.diff(np.r_[0, cut]), strict=True):
            counts[i] += n
        out.append(h)
        pending.clear()
        size = 0

    for i, t in enumerate(texts):
        if not t:
            continue
        b = (t.lower() if letters else t).encode()
        at = 0
        while len(b) - at > most:
            m = SEPARATOR.search(b, at + most)
            end = m.start() if m else len(b)
            flush()
            pending.append((i, b[at:end]))
            flush()
            at = end
        pending.append((i, b[at:] if at else b))
        size += len(b) - at
        if size > most:
            flush()
    flush()
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), (np.concatenate(last) if last else np.empty(0, np.uint16)), counts

"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A delta is a row with a sign: an insert adds a document's counts (+1), a delete takes them back (-1), a revision does both with the old
and the new counts. A batch of deltas is summed by group and written into a folder of the attempt, in the batch's folder; of the attempts
that have Spark's success mark the first by name - by the time it began - counts. So a batch that is committed again - after a lost
driver, twice by mistake, or by two drivers at once - counts once. Any text is a batch's name. Totals are the sums over all committed
batches; groups that fell to no documents and no tokens are not reported. `compact` sums the batches so far into a base folder that names
them; batches that the newest whole base names are read from it alone, so a compaction that is cut short, or done twice, changes no total,
nor does an attempt that ends after its batch was compacted. Only the names of batches since the last compaction reach the driver.

Null texts count no tokens and no characters; null sources and languages are groups of their own; repeated rows count as often as they
occur; an empty batch commits and changes nothing; no batches give no totals. Other columns are not read.
"""

from __future__ import annotations

import time
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm import common as C
from trailframe.sources.shared import shared_folder

VERSION = "byte_bpe_50k"
GROUP = ["source", "lang", "tokenizer"]
MEASURES = ["n_docs", "n_tokens", "n_chars"]
DELTA = "doc_id long, sign int, source string, lang string, tokenizer string, n_tokens long, n_chars long"
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
#: Characters of a text that the tokenizer gets at once; texts are cut in front of a space, where no token crosses.
PIECE = 100_000


def count_tokens(text: str | None, enc) -> int:
    """Tokens of the whole text; a cut is made only before a single space between letters, which no piece of the pattern spans."""
    if not text:
        return 0
    n, at = 0, 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and end + 1 < len(text) and text[end + 1].isalpha()):
            end += 1
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n + len(enc.encode_ordinary(text[at:]))


def _counted(vocabulary):
    state: list = []

    def run(batches):
        if not state:
            state.append(C.load_encoding(vocabulary.value))
        for batch in batches:
            n = pa.array([count_tokens(t.as_py(), state[0]) for t in batch.column("text")], pa.int64())
            names = ["doc_id", "source", "lang", "n_chars"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), n], [*names, "n_tokens"])

    return run


def deltas(docs: DataFrame, sign: int = 1, vocabulary: str = C.VOCABULARY, version: str = VERSION) -> DataFrame:
    """A signed row of counts for each document."""
    book = C.broadcast_vocabulary(docs.sparkSession, vocabulary)
    n_chars = F.coalesce(F.length(docs["text"]), F.lit(0)).cast("long")
    plain = [docs[c].cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("text", "string"))]
    docs = docs.select(*plain, n_chars.alias("n_chars"))
    rows = docs.mapInArrow(_counted(book), "doc_id long, source string, lang string, n_chars long, n_tokens long")
    return rows.select("doc_id", F.lit(sign).alias("sign"), "source", "lang", F.lit(version).alias("tokenizer"), "n_tokens", "n_chars")


class Rollup:
    """Totals in a folder that all executors share: one folder for each batch, and bases of many."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._jvm_path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, kind: str, root: str | None = None) -> dict[str, str]:
        """Name -> folder of all that begin so."""
        at = self._jvm_path(root or self.root)
        if not self._files.exists(at):
            return {}
        found = [x.getPath().toString() for x in self._files.listStatus(at)]
        return {unquote(name.removeprefix(kind)): f for f in found if (name := f.rsplit("/", 1)[1]).startswith(kind)}

    def _whole(self, folder: str) -> bool:
        return self._files.exists(self._jvm_path(f"{folder}/_SUCCESS"))

    def _base(self) -> str | None:
        """The newest base's folder."""
        return max((f for f in self._folders("base-").values() if self._whole(f)), default=None)

    def _named(self, base: str | None) -> DataFrame:
        """The names of the batches in a base."""
        return self.spark.read.schema("name string").parquet(f"{base}/names") if base else self.spark.createDataFrame([], "name string")

    def _fresh(self, base: str | None, only: str | None = None) -> dict[str, str]:
        """Name -> folder of the attempt that counts, of the batches (or the only one asked for) that the base doesn't hold."""
        out = {}
        for name, folder in self._folders("batch-").items():
            if only is None or name == only:
                done = sorted(f for f in self._folders("attempt-", folder).values() if self._whole(f))
                if done:
                    out[name] = done[0]
        if base and out:
            asked = self.spark.createDataFrame([(n,) for n in out], "name string")
            for r in asked.join(self._named(base), "name", "left_semi").collect():
                del out[r["name"]]
        return out

    def committed(self) -> set[str]:
        """The names of all batches: for tests and small folders."""
        base = self._base()
        return {r["name"] for r in self._named(base).collect()} | set(self._fresh(base))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Sums the batch and writes it; False, and nothing is read, if that batch has been committed."""
        base = self._base()
        if self._fresh(base, batch_id) or (base and not self._named(base).where(F.col("name") == batch_id).isEmpty()):
            return False
        sign = F.col("sign").cast("long")
        sums = changes.groupBy(*GROUP).agg(F.sum(sign).alias("n_docs"), F.sum(sign * F.col("n_tokens")).alias("n_tokens"), F.sum(sign * F.col("n_chars")).alias("n_chars"))
        sums.write.parquet(f"{self.root}/batch-{quote(batch_id, safe='')}/attempt-{time.time_ns():020d}-{uuid.uuid4().hex}")
        return True

    def _rows(self, base: str | None, fresh: dict[str, str]) -> DataFrame:
        folders = [*([f"{base}/sums"] if base else []), *fresh.values()]
        rows = self.spark.read.schema(SUMS).parquet(*folders) if folders else self.spark.createDataFrame([], SUMS)
        return rows.groupBy(*GROUP).agg(*[F.sum(m).alias(m) for m in MEASURES])

    def totals(self) -> DataFrame:
        base = self._base()
        return self._rows(base, self._fresh(base)).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Sums all committed batches into a new base, then removes what it replaces. One compaction at a time: of two, one might not
        hold what the other removed."""
        base = self._base()
        fresh, bases = self._fresh(base), self._folders("base-")
        if not fresh:
            return
        folder = f"{self.root}/base-{int(max(bases, default='0').split('-')[0]) + 1:012d}-{uuid.uuid4().hex}"
        self._rows(base, fresh).write.parquet(f"{folder}/sums")
        self._named(base).unionByName(self.spark.createDataFrame([(n,) for n in sorted(fresh)], "name string")).write.parquet(f"{folder}/names")
        self._files.create(self._jvm_path(f"{folder}/_SUCCESS"), True).close()
        replaced = [f for f in bases.values() if base and f <= base]
        for old in [*replaced, *(f.rsplit("/", 1)[0] for f in fresh.values())]:
            self._files.delete(self._jvm_path(old), True)

    def drop(self) -> None:
        self._files.delete(self._jvm_path(self.root), True)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that take back `old` inserts and make `new` ones, as one batch."""
    return old.withColumn("sign", -F.col("sign")).unionByName(new)


def op8_token_rollup(spark, sf_dir: str) -> DataFrame:
    """Totals of all documents, by five batches of deltas. The load brings some documents (a fold by hash) in an older version, with their
    words in lower case, and some under the source `staging`; a revision brings the first to their present counts, deletes and inserts
    move the others to their source. The load is committed again, and all batches are compacted, which changes nothing."""
    docs = C.read(spark, sf_dir, "documents")
    fold = F.coalesce(C.fold_column(F.col("doc_id"), 20), F.lit(19))
    old, moved = docs.where(fold == 0), docs.where(fold == 1)
    staged = moved.withColumn("source", F.lit("staging"))
    first = docs.withColumn("text", F.when(fold == 0, F.lower("text")).otherwise(F.col("text"))).withColumn("source", F.when(fold == 1, F.lit("staging")).otherwise(F.col("source")))
    rollup = Rollup(spark, f"{shared_folder(spark)}/rollups/{uuid.uuid4().hex}")
    try:
        rollup.commit("load", deltas(first))
        rollup.commit("revise/1", revisions(deltas(old.withColumn("text", F.lower("text"))), deltas(old)))
        rollup.commit("withdraw", deltas(staged, -1))
        rollup.compact()
        rollup.commit("insert", deltas(moved))
        rollup.commit("load", deltas(first))
        rollup.compact()
        return C.checkpoint(rollup.totals().select(*GROUP, *MEASURES))
    finally:
        rollup.drop()

"""Delta-maintained token counts.

A change of the corpus is described by the rows as they were and the rows as
they are: an insert is only in the second, a delete only in the first, a
revision in both.  Their signed sums by (source, lang, tokenizer) are one
*delta*; deltas add up, so totals never need the corpus again.

Each batch's delta is committed under the batch's name by one rename, into a
folder that must not exist yet.  Committing a name again changes nothing, so a
batch that is delivered twice, or whose driver died at any point, counts once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.llm import kernels
from sampleloom.llm.storage import shared_dir
from sampleloom.shipping import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of at least so many characters is encoded apart.
LONG_RUN = 10_000
_LONG_SPACE = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}")
KEYS = ["source", "lang", "tokenizer"]
_encodings: dict[str, object] = {}


class Tokenizer:
    """A public rank-file tokenizer; ``version`` names the vocabulary and its content."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        self.ranks = Path(vocabulary).read_bytes()
        self.pattern = pattern
        self.version = f"{Path(vocabulary).stem}@{hashlib.sha256(self.ranks + pattern.encode()).hexdigest()[:12]}"

    def encoding(self):
        """The encoder, built once for each process."""
        if self.version not in _encodings:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            _encodings[self.version] = tiktoken.Encoding(self.version, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _encodings[self.version]

    def count(self, text: str) -> int:
        """The number of tokens; names of special tokens are ordinary text.

        The encoder's pattern runs out of stack on very long white space, so with the pattern above such runs are
        taken out first: all of a run but its last character is one piece of that pattern (all of it at the text's
        end), and what comes before and after it is split as if it stood alone.
        """
        encoding = self.encoding()
        if len(text) < LONG_RUN or self.pattern != PATTERN:
            return len(encoding.encode_ordinary(text))
        total, at = 0, 0
        for run in _LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            total += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
            at = end
        return total + len(encoding.encode_ordinary(text[at:]))


def counted(df: DataFrame, tokenizer: Tokenizer, texts: list[str]) -> DataFrame:
    """The rows with the number of tokens (LONG) in place of each of the text columns, null for a null text."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(tokenizer)
    names = df.columns

    def run(batches):
        count = shared.value.count
        for batch in batches:
            for part in kernels.rebatch([batch], text=texts[0]):
                cols = [pa.array([None if t is None else count(t) for t in c.to_pylist()], pa.int64()) if n in texts else c for n, c in zip(names, part.columns)]
                yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, T.LongType()) if f.name in texts else f for f in df.schema.fields]))


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, revised: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens): the whole texts' tokens.

    With ``revised``, another text of each row or null, there is a column revised for its tokens, null for null.
    Special tokens' names are ordinary text.  A null or empty text has none.
    Other columns are left out; nulls in source and lang stay.
    """
    columns = [F.col(c).cast("long" if c == "doc_id" else "string").alias(c) for c in ("doc_id", "source", "lang", "text")]
    if revised is not None:
        columns.append(revised.cast("string").alias("revised"))
    made = counted(docs.select(*columns), tokenizer, ["text", "revised"][: len(columns) - 3])
    return made.select("doc_id", "source", "lang", F.lit(tokenizer.version).alias("tokenizer"), F.coalesce("text", F.lit(0)).alias("tokens"), *made.columns[4:])


def delta(before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """(source, lang, tokenizer, documents, tokens): what the change from ``before`` to ``after`` adds, with its sign.

    Both have source, lang, tokenizer and tokens, one row for each document.
    Null keys are groups of their own; null tokens count 0; repeated rows count
    each time.
    """
    parts = []
    for df, sign in ((before, -1), (after, 1)):
        if df is not None:
            parts.append(df.select(*KEYS, F.lit(sign).cast("long").alias("documents"), (F.coalesce("tokens", F.lit(0)) * sign).cast("long").alias("tokens")))
    if not parts:
        raise ValueError("a change needs rows before or after it")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 OR tokens <> 0")


class TokenRollup:
    """Totals by source, language and tokenizer version below a shared folder."""

    SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/sampleloom/rollup-{uuid.uuid4().hex}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        p, fs = self._fs(f"{self.path}/deltas/{quote(batch, safe='')}")
        return fs.exists(p)

    def commit(self, batch: str, change: DataFrame) -> bool:
        """Adds the change (see :func:`delta`) under the batch's name; False if that name was there already."""
        if self.committed(batch):
            return False
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        change.select(*KEYS, "documents", "tokens").coalesce(1).write.parquet(staged)  # at most one row for each key
        source, fs = self._fs(staged)
        target, _ = self._fs(f"{self.path}/deltas/{quote(batch, safe='')}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
            return False
        inside, _ = self._fs(f"{target}/{source.getName()}")
        if fs.exists(inside):  # the target came into being in between, and the rename went below it
            fs.delete(inside, True)
            return False
        return True

    def totals(self) -> DataFrame:
        """The sums of all committed deltas; keys whose documents and tokens are both 0 are left out."""
        p, fs = self._fs(f"{self.path}/deltas")
        if not fs.exists(p) or not list(fs.listStatus(p)):
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", "true").parquet(f"{self.path}/deltas")
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")

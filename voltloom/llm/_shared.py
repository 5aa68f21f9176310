"""What the text operators have in common: shared folder, slices of Arrow batches, word caches."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one slice of a batch may hold; bounds a Python worker's memory whatever the batch size.
SLICE_BYTES = 3_000_000
#: Words that a worker remembers; later new words are computed again each time they occur.
CACHE_WORDS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where unset one of our own, if one machine runs all (as in tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        found = sc._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("a cluster needs a folder that all executors share: set spark.checkpoint.dir")
        path = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="voltloom-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, reliably checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text under fixed names; other columns, whatever their names, are out of the way."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def spare(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with about `most` bytes of text or a single row."""
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    part = (np.cumsum(size) - size) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, n]):
        yield batch.slice(a, b - a)


def pieces(text: str, most: int = 1_000_000) -> Iterator[str]:
    """text in pieces of about `most` characters, cut only between a word and a single space before the next word.

    There every pattern used here ends a match, so matching piece by piece equals matching the whole.
    """
    at = 0
    while len(text) - at > most:
        found = _CUT.search(text, at + most)
        if not found:
            break
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:] if at else text


_CUT = re.compile(r"\S (?=\S)")


class WordIds(dict):
    """Numbers words; what is new since the last flush is in `fresh`. Keeps the first `most` that it meets for good, frequent or not."""

    def __init__(self, most: int = CACHE_WORDS) -> None:
        super().__init__()
        self.most, self.kept, self.fresh = most, 0, []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def settle(self) -> int:
        """Forget words beyond the first `most`; returns how many stay."""
        if len(self) > self.most:
            for word in [w for w, n in reversed(self.items()) if n >= self.most]:
                del self[word]
        self.fresh = []
        return len(self)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of each of the given runs, one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


def grams(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of ^word$ and the word itself, as (features, number for each word)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lens) - lens
    left = np.repeat(starts + lens, lens) - np.arange(len(flat))
    owner = np.repeat(np.arange(len(words)), lens)
    hashes, owners = [], []
    acc = np.zeros(len(flat), np.uint64)
    for n in range(1, max(sizes) + 1):
        acc = acc[: len(flat) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + flat[n - 1 :] + np.uint64(n)
        if n in sizes:
            ok = left[: len(acc)] >= n
            hashes.append(acc[ok])
            owners.append(owner[: len(acc)][ok])
    whole = np.add.reduceat(flat * (np.repeat(lens, lens) - left + 1).astype(np.uint64) ** np.uint64(3) * np.uint64(0xD6E8FEB86659FD93), starts)
    hashes.append(whole)
    owners.append(np.arange(len(words)))
    h, o = np.concatenate(hashes), np.concatenate(owners)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(o, kind="stable")
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)[order], np.bincount(o, minlength=len(words))

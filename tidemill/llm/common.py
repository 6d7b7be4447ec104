"""What the operators share: shared-folder tables, and vectorised words and hashes over Arrow text columns."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: A written table whose rows take at most so many bytes in memory may be broadcast.
BROADCAST_BYTES = 8 << 20
#: Settings while a table is written: its shuffle files go at once, since nothing runs its plan again, and batches to Python are small.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", BATCH_BYTES: "4m"}
#: The bytes that part words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none: a new one in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    was = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialise() that nothing reads any more."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Collects tables of materialise() that go when the block ends, by an error too."""
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df)
        return df

    try:
        yield keep
    finally:
        for df in held:
            discard(df)


def small_batches(spark: SparkSession) -> None:
    """Let the session hand Python at most 8 MiB at once, unless it has a setting of its own: whole texts go through, twice where rows are carried."""
    if spark.conf.get(BATCH_BYTES) == "67108864b":  # as it comes
        spark.conf.set(BATCH_BYTES, "8m")


#: Bytes that one value of a type takes where it is broadcast, about; hexadecimal digests are the longest strings here.
VALUE_BYTES = {"string": 112, "binary": 64}


def bounded(df: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """df with a broadcast hint if the rows of the materialised table that it selects from, at the width of df's columns, are few enough.

    Otherwise df as it is, for a shuffled join. Rows are counted from the files' footers.
    """
    width = sum(VALUE_BYTES.get(f.dataType.typeName(), 16) for f in df.schema.fields)
    return F.broadcast(df) if (written or df).count() * width <= BROADCAST_BYTES else df


def repeats_ids(docs: DataFrame, nulls: bool = False) -> bool:
    """Whether any doc_id, or with nulls a missing one, stands on more than one row."""
    known = docs if nulls else docs.where("doc_id IS NOT NULL")
    most = known.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    return (most or 0) > 1


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def delimiters(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


SPACE_TABLE = delimiters(SPACES)
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32

_S = np.uint64(0xD1342543DE82EF95)
_S_INV = np.uint64(pow(int(_S), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}
#: Byte ranges longer than this are hashed and compared one by one.
LONG = 256
#: The first n bytes of a little-endian 64-bit number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers; zeros follow the last byte."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range: eight bytes at a time, each step mixed before the next.

    Ranges that collide under one salt do not under another, but by chance again. Where equality must
    not rest on chance, bytes are compared as well (equal_spans, codes).
    """
    eights, left = _eights(buf), ends - starts
    h = mix(left.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64))
    at, own, live = starts, left, None
    if len(left) and left.max() > LONG:
        for i in np.flatnonzero(left > LONG):
            own_digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little"))
            h[i] = int.from_bytes(own_digest.digest(), "little")
        live = np.flatnonzero(left <= LONG)
        at, own = starts[live], left[live]
    while len(at):
        x = eights[at] & _FIRST[np.minimum(own, 8)]
        if live is None:
            h = mix(h + mix(x ^ np.uint64(0xA0761D6478BD642F)))
        else:
            h[live] = mix(h[live] + mix(x ^ np.uint64(0xA0761D6478BD642F)))
        more = np.flatnonzero(own > 8)
        live = more if live is None else live[more]
        at, own = at[more] + 8, own[more] - 8
    return h


def equal_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each byte range of buf has the very bytes of its range of other."""
    same = ends - starts == other_ends - other_starts
    mine = _eights(buf)
    theirs = mine if other is buf else _eights(other)
    live = np.flatnonzero(same)
    if len(live) and (ends - starts)[live].max() > LONG:
        for i in live[(ends - starts)[live] > LONG]:
            same[i] = np.array_equal(buf[starts[i] : ends[i]], other[other_starts[i] : other_ends[i]])
        live = live[(ends - starts)[live] <= LONG]
    a, b, left = starts[live], other_starts[live], (ends - starts)[live]
    while len(live):
        differ = ((mine[a] ^ theirs[b]) & _FIRST[np.minimum(left, 8)]) != 0
        same[live[differ]] = False
        more = np.flatnonzero(~differ & (left > 8))
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    return same


def codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, code): equal byte ranges, and only those, have one code; first[c] is a range of code c.

    Ranges are sorted by hash and compared with their code's first; a collision means another salt.
    """
    salt = 0
    while True:
        _, first, code = np.unique(span_hashes(buf, starts, ends, salt), return_index=True, return_inverse=True)
        if equal_spans(buf, starts, ends, buf, starts[first][code], ends[first][code]).all():
            return first, code
        salt += 1


class Words:
    """The words of some documents: byte ranges in one buffer, 64-bit hashes, and each document's first word.

    buf holds the texts one after another; a word never spans two documents. doc_at[d]:doc_at[d + 1] are
    the words of document d.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, delim: np.ndarray, lower: bool = False, salt: int = 0):
        self.raw = buf
        self.buf = LOWER_TABLE[buf] if lower else buf
        n = len(buf)
        word = ~delim[self.buf] if n else np.zeros(0, dtype=bool)
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = offsets[(offsets > 0) & (offsets < n)]
        first[inner] = word[inner]
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[inner - 1] = word[inner - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.doc_at = np.searchsorted(self.starts, offsets)
        self.salt = salt

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.hashed(self.salt)

    def hashed(self, salt: int) -> np.ndarray:
        """The words' hashes under another salt."""
        return span_hashes(self.buf, self.starts, self.ends, salt)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_at) - 1), np.diff(self.doc_at))

    def runs(self, k: int, salt: int = 0) -> np.ndarray:
        """The hash of the k words from each word on; where fewer remain in the buffer there is none."""
        return run_hashes(self.hashes, k, salt)

    def whole(self, k: int) -> np.ndarray:
        """Whether k words of the same document start at each word that runs() covers."""
        n = max(0, len(self.starts) - k + 1)
        left = np.repeat(self.doc_at[1:], np.diff(self.doc_at)) - np.arange(len(self.starts))
        return left[:n] >= k


def run_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    n = len(words)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    own = mix(words + np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)) if salt else words
    np.cumsum(own * _power(_S, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _power(_S_INV, n + 1)[: n - k + 1] + np.uint64(k + salt))


def range_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of words[start:end] for each pair; it tells lengths apart."""
    n = len(words)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * _power(_S, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_S_INV, n + 1)[start] + (end - start).astype(np.uint64))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets without a copy; nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    if not len(col):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return buf, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Whole rows in slices of about `most` text bytes, each with its bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, off = column_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False))

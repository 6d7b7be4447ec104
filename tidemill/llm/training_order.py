"""Training-order output: token sequences in fixed-stride binary shards, ordered by a keyed Feistel permutation."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, discard, materialise, repeats_ids, scratch, shared_dir, slices, text_or_empty

#: A record is this head (document, part, tokens; ~tokens if there is no document) and the tokens, little-endian.
HEAD = "<qii"
HEAD_BYTES = struct.calcsize(HEAD)
MANIFEST = "manifest.json"

#: Rows of a chunk, about, sequences that a task scatters to shards at once, and chunks whose sums are added up in one step.
CHUNK_ROWS, BLOCK, SUMS = 5_000, 32_768, 4_096


@dataclass(frozen=True)
class Params:
    """length: tokens of a sequence. key: of the order. shard: sequences of a shard file. end, fill: token ids after a text and after a sequence's last token.

    token_bytes: of an id in a record, 2 or 4; a larger id is an error.
    """

    length: int = 256
    key: str = "epoch-0"
    shard: int = 8_192
    end: int = 50_256
    fill: int = 50_256
    token_bytes: int = 2

    @property
    def stride(self) -> int:
        return HEAD_BYTES + self.token_bytes * self.length

    @property
    def kind(self) -> str:
        return f"<u{self.token_bytes}"


class Permutation:
    """A keyed bijection of 0 .. n - 1: a balanced Feistel network over the least even number of bits
    that holds n, walked until it lands below n."""

    def __init__(self, n: int, key: str, rounds: int = 6):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        digest = [hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest() for r in range(rounds)]
        self.keys = [np.uint64(int.from_bytes(d, "little")) for d in digest]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x).astype(np.uint64), back)
        out = np.flatnonzero(x >= self.n)
        while len(out):
            x[out] = self._once(x[out], back)
            out = out[x[out] >= self.n]
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


@lru_cache(maxsize=2)
def load(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Code points of a text that are encoded at once, about.
PIECE = 1 << 18
#: Between a letter and a space that a letter follows, a match of the pattern always ends.
SAFE = regex.compile(r"(?<=\p{L})(?= \p{L})")
BLANK = regex.compile(r"\p{White_Space}")


@lru_cache(maxsize=2)
def _matcher(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def tokens(enc, text: str, piece: int = PIECE) -> list[int]:
    """The ids of the whole text. A long one is encoded in pieces that end where a match of the encoding's pattern ends, so the ids are the same."""
    out, at = [], 0
    while len(text) - at > piece:
        found = SAFE.search(text, at + piece // 2, at + piece)
        if found:
            out += enc.encode_ordinary(text[at : found.start()])
            at = found.start()
            continue
        sure, blanks = at, []  # where a match ended that is no white space, and the matches of white space since: cut off, two of them would be one
        for m in _matcher(enc._pat_str).finditer(text, at):  # no such place: match by match
            if m.end() - m.start() > piece // 2:
                out += enc.encode_ordinary(text[at:sure])
                for own in (*blanks, m.group()):
                    out += enc._encode_single_piece(own)
                at = m.end()
                break
            if BLANK.match(m.group()[-1]):
                blanks.append(m.group())
                continue
            sure, blanks = m.end(), []
            if sure - at > piece // 2:
                out += enc.encode_ordinary(text[at:sure])
                at = sure
                break
        else:
            break
    return out + enc.encode_ordinary(text[at:])


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and twin: 0, or the number of the row among those that repeat a doc_id."""
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    if not repeats_ids(docs):
        return docs.withColumn("twin", F.lit(0))
    return docs.withColumn("twin", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1)


def tokenised(docs: DataFrame, p: Params, ranks: str | None) -> DataFrame:
    """(doc_id, chunk, start, n, packed): each text's ids, packed, with the number of its first sequence within its chunk.

    A chunk is a hash class of doc_ids and twins, their number set by the number of rows; in it texts stand by doc_id and twin.
    """
    rows = docs.count()
    chunks = max(8, -(-rows // CHUNK_ROWS))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, press = load(ranks or default_ranks()), zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for b, _, _ in slices([whole]):
                own = [_packed([*tokens(enc, t), p.end], p) for t in b.column(0).to_pylist()]
                packed = [press.compress(x.tobytes()) for x in own]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (1, 2, 3)), pa.array([len(x) for x in own], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "twin", "chunk", "n", "packed"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, start = None, 0
        for b in batches:
            starts = []
            for c, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                chunk, start = c, start if c == chunk else 0
                starts.append(start)
                start += -(-n // p.length)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(starts, pa.int64()), b.column(3), b.column(4)], names=["doc_id", "chunk", "start", "n", "packed"])

    chunk = F.pmod(F.xxhash64("doc_id", "twin"), F.lit(chunks)).cast("int")
    own = docs.select("text", "doc_id", "twin", chunk.alias("chunk")).mapInArrow(encode, "doc_id long, twin int, chunk int, n long, packed binary")
    spread = own.repartition("chunk").sortWithinPartitions("chunk", F.col("doc_id").asc_nulls_first(), "twin")
    return materialise(spread.mapInArrow(place, "doc_id long, chunk int, start long, n long, packed binary"), "tokens")


def _packed(ids: list[int], p: Params) -> np.ndarray:
    if max(ids) >= 1 << 8 * p.token_bytes:
        raise ValueError(f"token id {max(ids)} does not fit Params.token_bytes = {p.token_bytes}")
    return np.array(ids, dtype=p.kind)


def _bases(found: DataFrame, p: Params) -> DataFrame:
    """(chunk, base): how many sequences stand in the chunks before; sums of SUMS chunks are added up first, then those within."""
    sums = found.groupBy("chunk").agg(F.sum(F.ceil(F.col("n") / p.length)).alias("own")).withColumn("block", F.floor(F.col("chunk") / SUMS))
    before = lambda w: F.coalesce(F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("block").agg(F.sum("own").alias("own")).select("block", before(Window.partitionBy(F.lit(0)).orderBy("block")).alias("ahead"))
    within = sums.withColumn("base", before(Window.partitionBy("block").orderBy("chunk")))
    return within.join(blocks, "block").select("chunk", (F.col("base") + F.col("ahead")).alias("base"), "own")


def write_shards(docs: DataFrame, out_dir: str | None = None, p: Params = Params(), ranks: str | None = None) -> DataFrame:
    """Write every text's tokens as shards and return (doc_id, part, slot, shard, offset, n_tokens, crc32, path), one row per sequence.

    A text's tokens, with one end token, are cut into sequences of p.length. All sequences are numbered by
    chunk (a hash class of doc_ids and twins), doc_id (nulls first; rows that repeat one by text) and part, and a keyed permutation of those numbers gives
    each its slot. Shard k has the slots from k * p.shard on, in order, in records of p.stride bytes: slot s
    is at (s % p.shard) * p.stride. Each task writes a range of shards. So a reader can resume at any slot, and a lost or repeated task
    writes the same bytes: files are written beside their place and then moved there. Null and empty texts
    are one sequence of the end token. An empty table writes no shard. When all is written, a manifest says how many
    sequences there are: shards of an older run in the same folder beyond that are not read.

    The files are written by the call; what it returns is a written table. out_dir: a folder that all executors share, as a URI that pyarrow can write; by default a new one in the shared folder.
    The column path names it. Other columns of docs are not looked at. Texts are encoded once; what goes between
    stages is compressed, and each stage's input goes when its output is written. Sums of chunks are added up by joins, the total alone is on the driver.
    """
    spark = docs.sparkSession
    out_dir = out_dir or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    where, root = fs.FileSystem.from_uri(out_dir)
    where.create_dir(root, recursive=True)
    if where.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
        where.delete_file(f"{root}/{MANIFEST}")
    with scratch() as keep:
        packed, total = _packed_shards(docs, p, ranks, keep)
        index = materialise(packed.mapInArrow(_writer(out_dir, p), "doc_id long, part long, slot long, shard int, offset long, n_tokens int, crc32 long"), "shard-index")
    manifest = {"total": total, "shard": p.shard, "length": p.length, "token_bytes": p.token_bytes, "key": p.key, "stride": p.stride}
    with where.open_output_stream(f"{root}/.{MANIFEST}") as f:
        f.write(json.dumps(manifest).encode())
    where.move(f"{root}/.{MANIFEST}", f"{root}/{MANIFEST}")
    return index.withColumn("path", F.lit(out_dir))


def _packed_shards(docs: DataFrame, p: Params, ranks: str | None, keep) -> tuple[DataFrame, int]:
    """(shard, n, packed): the records of each shard in slot order, compressed and written; and the number of all sequences."""
    found = tokenised(_numbered(docs), p, ranks)
    bases = keep(materialise(_bases(found, p), "bases"))
    total = bases.agg(F.sum("own")).first()[0] or 0
    sent = docs.sparkSession.sparkContext.broadcast(Permutation(total, p.key))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        unpress = zstandard.ZstdDecompressor()
        number, records = [], []
        for b in batches:
            for doc_id, base, start, n, packed in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                own = np.frombuffer(unpress.decompress(packed, max_output_size=p.token_bytes * n), dtype=p.kind)
                for k in range(0, n, p.length):
                    now = own[k : k + p.length]
                    fill = np.full(p.length - len(now), p.fill, dtype=p.kind)
                    head = struct.pack(HEAD, 0, k // p.length, ~len(now)) if doc_id is None else struct.pack(HEAD, doc_id, k // p.length, len(now))
                    records.append(head + now.tobytes() + fill.tobytes())
                    number.append(base + start + k // p.length)
                if len(records) >= BLOCK:
                    yield _blocks(number, records, order, p)
                    number, records = [], []
        if records:
            yield _blocks(number, records, order, p)

    shards = max(1, -(-total // p.shard))
    tasks = min(shards, MOST_TASKS)
    numbered = found.join(bounded(bases.select("chunk", "base"), bases), "chunk").select("doc_id", "base", "start", "n", "packed")
    blocks = numbered.mapInArrow(cut, "shard int, slots binary, packed binary")
    # Slots are a permutation, so shards are equally full: ranges of shards are ranges of rows without a sample.
    ranges = blocks.repartitionById(tasks, (F.col("shard").cast("long") * tasks / shards).cast("int")).sortWithinPartitions("shard")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        now, slots, records = None, [], []

        def whole():
            slot, data = np.concatenate(slots), np.concatenate(records)
            rank = np.argsort(slot)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(slot)], pa.int64()), pa.array([press.compress(data[rank].tobytes())], pa.binary())], names=["shard", "n", "packed"])

        for b in batches:
            for shard, s, packed in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != now and slots:
                    yield whole()
                    slots, records = [], []
                now = shard
                slots.append(np.frombuffer(s, dtype=np.int64))
                records.append(np.frombuffer(unpress.decompress(packed, max_output_size=len(slots[-1]) * p.stride), dtype=np.uint8).reshape(-1, p.stride))
        if slots:
            yield whole()

    packed = keep(materialise(ranges.mapInArrow(gather, "shard int, n long, packed binary"), "packed-shards"))
    discard(found)
    return packed, total


#: Tasks that write shards at most; each has a range of them.
MOST_TASKS = 100_000


def _writer(out_dir: str, p: Params):
    """(shard, n, packed) -> the rows of the records written: each shard is written beside its place and moved there."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(out_dir)
        unpress = zstandard.ZstdDecompressor()
        for b in batches:
            for shard, n, own in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data = unpress.decompress(own, max_output_size=n * p.stride)
                part = f"{root}/.{shard:08d}-{uuid.uuid4().hex}"
                with where.open_output_stream(part) as f:
                    f.write(data)
                where.move(part, f"{root}/shard-{shard:08d}.bin")
                at = np.arange(n) * p.stride
                heads = [_head(data, k) for k in at]
                cols = [
                    pa.array([h[0] for h in heads], pa.int64()),
                    pa.array([h[1] for h in heads], pa.int64()),
                    pa.array(shard * p.shard + np.arange(n)),
                    pa.array(np.full(n, shard, dtype=np.int32)),
                    pa.array(at),
                    pa.array([h[2] for h in heads], pa.int32()),
                    pa.array([zlib.crc32(data[k : k + p.stride]) for k in at], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "slot", "shard", "offset", "n_tokens", "crc32"])

    return write


def _head(data: bytes, at: int) -> tuple[int | None, int, int]:
    doc_id, part, n = struct.unpack_from(HEAD, data, at)
    return (None, part, ~n) if n < 0 else (doc_id, part, n)


def _blocks(number: list[int], records: list[bytes], order: Permutation, p: Params) -> pa.RecordBatch:
    """One compressed block for each shard that some of the records belong to."""
    press = zstandard.ZstdCompressor(level=1)
    slot = order.slot(np.array(number, dtype=np.int64))
    rank = np.argsort(slot, kind="stable")
    slot = slot[rank]
    cuts = np.flatnonzero(np.concatenate([[True], slot[1:] // p.shard != slot[:-1] // p.shard]))
    shard, slots, packed = [], [], []
    for a, z in zip(cuts, np.append(cuts[1:], len(slot)), strict=True):
        shard.append(int(slot[a] // p.shard))
        slots.append(slot[a:z].tobytes())
        packed.append(press.compress(b"".join(records[k] for k in rank[a:z])))
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(slots, pa.binary()), pa.array(packed, pa.binary())], names=["shard", "slots", "packed"])


def read_from(out_dir: str, slot: int, p: Params = Params()) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """(slot, doc_id, part, tokens) from a slot on, in order; a reader that stopped goes on with the next slot.

    The manifest says where the run ends; without one it has not been written to its end, which is an error.
    """
    where, root = fs.FileSystem.from_uri(out_dir)
    with where.open_input_stream(f"{root}/{MANIFEST}") as f:
        manifest = json.loads(f.read())
    if any(manifest[k] != getattr(p, k) for k in ("shard", "length", "token_bytes")):
        raise ValueError(f"the shards were written with {manifest}")
    while slot < manifest["total"]:
        with where.open_input_file(f"{root}/shard-{slot // p.shard:08d}.bin") as f:
            f.seek(slot % p.shard * p.stride)
            data = f.read()
        for at in range(0, len(data), p.stride):
            doc_id, part, n = _head(data, at)
            yield slot, doc_id, part, np.frombuffer(data, p.kind, n, at + HEAD_BYTES)
            slot += 1

"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, materialise, scratch, slices, small_batches

UNDETERMINED = "und"


@dataclass(frozen=True)
class Params:
    """snippets and snippet_chars bound the sample of each language: that many texts, a window of so much of each, both chosen by a hash of the text.

    chunk: bytes that are compressed by themselves, so that a long text's own repeats do not stand in
    for the dictionary. min_margin: least share by which the smallest must beat the second; a
    narrower prediction is rejected. level and min_match are zstandard's.
    """

    snippets: int = 96
    snippet_chars: int = 1200
    chunk: int = 1024
    min_margin: float = 0.01
    level: int = 5
    min_match: int = 3


#: Characters beyond the basic plane are looked at one by one; a class with them is searched slowly.
BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _kept(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


@lru_cache(maxsize=1)
def _others() -> re.Pattern:
    """Runs of what is neither a letter nor a mark, in the basic plane, as one class of code point ranges."""
    ranges, start = [], None
    for c in range(0x10001):
        other = c < 0x10000 and not _kept(chr(c))
        if other and start is None:
            start = c
        elif not other and start is not None:
            ranges.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return re.compile(f"[{''.join(ranges)}]+")


def letters(text: str) -> str:
    """The text in lower case with one space for all that stands between letters (categories L and M); empty without a letter."""
    low = BEYOND.sub(lambda m: m.group() if _kept(m.group()) else " ", text.lower())
    own = _others().sub(" ", low).strip()
    return own if any(map(str.isalpha, own)) else ""


class Compressors:
    """One compressor per language, each with a raw-content dictionary."""

    def __init__(self, contents: dict[str, bytes], p: Params):
        self.p, self.langs, self.with_dictionary = p, list(contents), []
        for content in contents.values():
            own = zstandard.ZstdCompressionParameters.from_level(p.level, dict_size=len(content), min_match=p.min_match, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=own)
            self.with_dictionary.append(zstandard.ZstdCompressor(dict_data=d, compression_params=own))

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the text's letters under each language's dictionary."""
        b, n = text.encode(), self.p.chunk
        parts = [b[i : i + n] for i in range(0, len(b), n)]
        return [sum(len(c.compress(x)) for x in parts) for c in self.with_dictionary]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability under two bits of evidence a byte saved, and whether the margin is too narrow."""
        own = letters(text or "")
        if not own or not self.langs:
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(own)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        least = sizes[best]
        second = min((s for k, s in enumerate(sizes) if k != best), default=least * 2)
        score = 1.0 / sum(4.0 ** min(0, max(least - s, -60)) for s in sizes)
        return self.langs[best], score, (second - least) < self.p.min_margin * second


def train(docs: DataFrame, p: Params = Params()) -> dict[str, bytes]:
    """Dictionary contents by language, of rows of docs (doc_id, text, lang) with a language and letters.

    Languages stand by falling count of rows, then name: ties of size go to the more common. The
    sample is bounded: the text of the smallest hash in each of `snippets` hash classes of a language, and of a
    longer one the window that starts at its hash modulo the places there are. doc_id and the order of rows play no part.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h")).where(F.col("text").rlike(r"\p{L}"))
    picked = known.select("lang", "h").groupBy("lang", F.pmod("h", F.lit(p.snippets)).alias("k")).agg(F.min("h").alias("h"), F.count("*").alias("n"))
    with scratch() as keep:
        picked = keep(materialise(picked, "sample"))
        count = {r["lang"]: r["n"] for r in picked.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        room = f"greatest(length(text) - {p.snippet_chars}, 0) + 1"
        window = F.expr(f"substring(text, CAST(pmod(shiftrightunsigned(h, 8), {room}) AS INT) + 1, {p.snippet_chars})")
        rows = known.join(bounded(picked.select("lang", "h"), picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min(window).alias("t")).collect()
    held: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["h"], r["t"])):
        held.setdefault(r["lang"], []).append(letters(r["t"]))
    return {lang: " ".join(held[lang]).encode() for lang in sorted(held, key=lambda x: (-count[x], x))}


def identify(docs: DataFrame, contents: dict[str, bytes], p: Params = Params()) -> DataFrame:
    """row (all columns of docs), lang_pred, score and rejected for each row of docs.

    A text that is null or has no letter is `und` with score 0; so is every text when no language was
    learned. Ties of size go to the language that was more common in training. Whole texts count. An
    empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressors(sent.value, p)
        for whole in batches:
            flat = pa.RecordBatch.from_arrays([whole.column(0), whole.column(0).field("text")], names=["row", "text"])
            for b, _, _ in slices([flat]):
                lang, score, rejected = zip(*(c.predict(t) for t in b.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(np.array(score)), pa.array(rejected)], names=["row", "lang_pred", "score", "rejected"])

    small_batches(docs.sparkSession)
    packed = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([*packed.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return packed.mapInArrow(run, schema)

"""Text: normal forms, words, spans, scripts, terms and signals."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import col

#: Fixed value: a word starts with a letter or digit and may go on with marks, quotes, dots and hyphens.
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}'’.-]*"
#: Scripts in the order in which a value is tested for them.
SCRIPTS = (("Hani", r"\p{IsHan}"), ("Jpan", r"\p{IsKatakana}|\p{IsHiragana}"), ("Cyrl", r"\p{IsCyrillic}"), ("Arab", r"\p{IsArabic}"), ("Latn", r"\p{IsLatin}"))
#: Boundaries between ASCII word characters and others.
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def collapse(x) -> Column:
    """Trimmed, lower case, runs of white space as one space: what T01 does short of Unicode forms."""
    return F.lower(F.trim(F.regexp_replace(col(x), r"\s+", " ")))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC, lower case, white space collapsed."""
    return s.map(lambda x: None if x is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).lower()).strip())


def words(x, pattern: str = WORD) -> Column:
    """T02. The words of a text, in order."""
    return F.regexp_extract_all(col(x), F.lit(f"({pattern})"), F.lit(1))


def ngrams(tokens, n: int) -> Column:
    """n-grams of an array of words, joined by a space (T03 without places)."""
    t = col(tokens)
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def code_point_slice(x, start, end) -> Column:
    """Code points start to end, counted from 0, the end exclusive."""
    return F.substring(col(x), col(start) + 1, col(end) - col(start))


def content_hash(x) -> Column:
    return F.sha2(col(x), 256)


def spans(docs: DataFrame, most: int = 5, version: str = "v1") -> DataFrame:
    """(doc_id, text) -> one row per 1- to `most`-gram: literal, normalized, start_offset, end_offset, ngram_size, occurrence_key.

    Offsets count code points of the NFC text, ends exclusive. Null texts have no spans.
    """
    import regex

    pattern = regex.compile(WORD)
    names = ["doc_id", "literal", "normalized", "start_offset", "end_offset", "ngram_size", "occurrence_key"]

    def run(batches):
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                nfc = unicodedata.normalize("NFC", text or "")
                digest = hashlib.sha256(nfc.encode()).hexdigest()
                at = [m.span() for m in pattern.finditer(nfc)]
                rows = []
                for i in range(len(at)):
                    for n in range(1, min(most, len(at) - i) + 1):
                        a, z = at[i][0], at[i + n - 1][1]
                        canonical = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", nfc[a:z]).lower()).strip()
                        rows.append((doc_id, nfc[a:z], canonical, a, z, n, hashlib.sha256(f"{digest}|{version}|{a}|{z}|{canonical}".encode()).hexdigest()))
                if rows:
                    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, literal string, normalized string, start_offset int, end_offset int, ngram_size int, occurrence_key string")


def _xxhash64(hexes: bytes) -> np.ndarray:
    """xxhash64 of Spark (seed 42) of strings of 64 bytes that stand one after the other."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, k: (v << np.uint64(k)) | (v >> np.uint64(64 - k))
    seed = 42
    lanes = np.frombuffer(hexes, "<u8").reshape(-1, 8)
    with np.errstate(over="ignore"):
        starts = [np.uint64((seed + x) % 2**64) for x in (int(p1) + int(p2), int(p2), 0, -int(p1))]
        v = [turn(turn(s + lanes[:, k] * p2, 31) * p1 + lanes[:, k + 4] * p2, 31) * p1 for k, s in enumerate(starts)]
        h = turn(v[0], 1) + turn(v[1], 7) + turn(v[2], 12) + turn(v[3], 18)
        for x in v:
            h = (h ^ (turn(x * p2, 31) * p1)) * p1 + p4
        h = h + np.uint64(64)
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def _canonical(nfc: str, at: list[tuple[int, int]], pattern) -> tuple[bytes, list[int], list[int]] | None:
    """A text whose slices from word to word are the normal forms of the spans, in UTF-8, and the words' starts and ends in it; None where spans have to be normalised one by one."""
    if nfc.isascii():
        low = nfc.lower()
    else:
        low = nfc.lower() if unicodedata.is_normalized("NFKC", nfc) else ""
        if len(low) != len(nfc) or "Σ" in nfc:  # a capital whose small letter depends on what follows, or is longer
            return None
    flat = re.sub(r"\s+", " ", low)
    if len(flat) != len(low):
        low = flat
        at = [m.span() for m in pattern.finditer(low)]
    flat = flat.encode()
    if len(flat) == len(low):
        return flat, [a for a, _ in at], [z for _, z in at]
    starts, ends, done, size = [], [], 0, 0
    for a, z in at:
        size += len(low[done:a].encode())
        starts.append(size)
        size += len(low[a:z].encode())
        ends.append(size)
        done = z
    return flat, starts, ends


def span_counts(docs: DataFrame, most: int = 5, version: str = "v1") -> DataFrame:
    """spans() counted by doc_id and ngram_size: spans, distinct_spans (normalized), last_offset, digest (xxhash64 of occurrence_key, by xor).

    Texts are moved once, by doc_id, instead of their spans, which are many times as large; a doc_id's distinct spans are held in one task.
    """
    import regex

    pattern = regex.compile(WORD)
    few = [chr(k) for k in range(0x300)]  # re is several times as fast, but does not know the classes
    first = "".join(re.escape(x) for x in few if pattern.match(x))
    later = "".join(re.escape(x) for x in [*few, "’"] if pattern.fullmatch("a" + x))
    plain, beyond = re.compile(f"[{first}][{later}]*"), re.compile("[^\u0000-\u02ff’]")

    def of_text(text):
        """For each size: the spans' normal forms in UTF-8, their last offset, their digest."""
        nfc = unicodedata.normalize("NFC", text or "")
        at = [m.span() for m in (pattern if beyond.search(nfc) else plain).finditer(nfc)]
        head = f"{hashlib.sha256(nfc.encode()).hexdigest()}|{version}|"
        froms, tos = [f"{head}{a}|".encode() for a, _ in at], [f"{z}|".encode() for _, z in at]
        known = _canonical(nfc, at, pattern)
        if known and len(known[1]) != len(at):
            known = None
        keys, sizes = [], []
        for n in range(1, min(most, len(at)) + 1):
            if known:
                flat, starts, ends = known
                forms = [flat[a:z] for a, z in zip(starts, ends[n - 1 :], strict=False)]
            else:
                forms = [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", nfc[a:z]).lower()).strip().encode() for (a, _), (_, z) in zip(at, at[n - 1 :], strict=False)]
            keys += [hashlib.sha256(a + z + form).digest() for a, z, form in zip(froms, tos[n - 1 :], forms, strict=False)]
            sizes.append((n, forms))
        if sizes:
            starts = np.cumsum([0, *(len(forms) for _, forms in sizes[:-1])])
            digests = np.bitwise_xor.reduceat(_xxhash64(b"".join(keys).hex().encode()), starts).tolist()
            yield from ((n, forms, at[-1][1], digest) for (n, forms), digest in zip(sizes, digests, strict=True))

    schema = pa.schema([("doc_id", pa.int64()), ("ngram_size", pa.int32()), ("spans", pa.int64()), ("distinct_spans", pa.int64()), ("last_offset", pa.int32()), ("digest", pa.int64())])

    def run(batches):
        rows, found, now = [], {}, None

        def close():
            for n, (count, distinct, last, digest) in found.items():
                rows.append((now, n, count, len(distinct), last, digest - 2**64 if digest >= 2**63 else digest))
            found.clear()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows.clear()
            return batch

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if doc_id != now:
                    close()
                    now = doc_id
                for n, forms, last, digest in of_text(text):
                    count, distinct, end, key = found.get(n, (0, set(), 0, 0))
                    distinct.update(forms)
                    found[n] = count + len(forms), distinct, max(end, last), key ^ digest
            if rows:
                yield out()
        close()
        if rows:
            yield out()

    d = docs.select("doc_id", "text").repartition("doc_id").sortWithinPartitions("doc_id")
    return d.mapInArrow(run, "doc_id long, ngram_size int, spans long, distinct_spans long, last_offset int, digest long")


def script(x) -> Column:
    """The first script of the list that the value has a character of, else Zyyy."""
    return reduce(lambda c, s: c.when(col(x).rlike(s[1]), s[0]), SCRIPTS[1:], F.when(col(x).rlike(SCRIPTS[0][1]), SCRIPTS[0][0])).otherwise("Zyyy")


def scripts(x) -> Column:
    """All scripts of the list that the value has."""
    return F.array_compact(F.array(*[F.when(col(x).rlike(p), F.lit(n)) for n, p in SCRIPTS]))


def code_switched(x) -> Column:
    """Whether Latin stands beside Han, Kana, Hangul, Cyrillic or Arabic."""
    other = col(x).rlike(r"\p{IsHan}|\p{IsKatakana}|\p{IsHiragana}|\p{IsHangul}|\p{IsCyrillic}|\p{IsArabic}")
    return F.coalesce(col(x).rlike(r"\p{IsLatin}") & other, F.lit(False))


def language_capability(language, has_pack, observed_scripts, expected_scripts) -> Column:
    """What may be concluded in a language: SUPPORTED, PARTIAL, SCRIPT_MISMATCH or UNSUPPORTED."""
    shared = F.size(F.array_intersect(col(observed_scripts), col(expected_scripts)))
    return F.when(col(language).isNull() | (col(language) == "und"), "UNSUPPORTED").when(~col(has_pack), "PARTIAL").when((F.size(col(observed_scripts)) > 0) & (shared == 0), "SCRIPT_MISMATCH").otherwise("SUPPORTED")


def canonical_language(x) -> Column:
    """The lower-case primary subtag of a language code, und without one."""
    c = F.lower(F.regexp_extract(F.trim(col(x)), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(c.isNull() | (c == ""), "und").otherwise(c)


def matches_term(x, term: str) -> Column:
    """Whether a text has a term (T10): CJK terms and phrases anywhere; a word at word bounds, and anywhere if longer than 4."""
    low, t = F.lower(col(x)), term.lower().strip()
    if re.search(r"[぀-ヿ㐀-鿿가-힯]|\s", t) or len(t) > 4:
        return low.contains(t)
    return low.rlike(START + re.escape(t) + END)


def matches_any(x, terms) -> Column:
    """The terms, of a fixed list, that a text has, in order."""
    return F.array_compact(F.array(*[F.when(matches_term(x, t), F.lit(t)) for t in terms]))


def signals(x, families: dict[str, str]) -> Column:
    """Names of the families whose pattern a text matches."""
    return F.array_compact(F.array(*[F.when(col(x).rlike(p), F.lit(n)) for n, p in families.items()]))


#: Fixed value: wording that tries to steer a reader that is a program, between word bounds.
INJECTION = r"(?i)(?:^|[^0-9A-Za-z_])(?:ignore (?:all |previous )?instructions|system prompt|developer message|jailbreak|respond with)(?:[^0-9A-Za-z_]|$)"


def injected(x) -> Column:
    return F.coalesce(col(x).rlike(INJECTION), F.lit(False))


def sanitize_query(x) -> Column:
    """A search text without operators, quotes and doubled spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(x), r"""["'“”()|+*]|(?<=^|\s)-""", " "), r"\s+", " "))


def subscribers(x) -> Column:
    """'1.2K', '3M', '900' as a number; anything else, HIDDEN too, is null (T15, the strict reading)."""
    s = F.upper(F.regexp_replace(F.trim(col(x)), r"[,\s]", ""))
    n = F.regexp_extract(s, r"^([0-9]+(?:\.[0-9]+)?)([KMB]?)$", 1)
    unit = F.regexp_extract(s, r"([KMB])$", 1)
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.when(s.rlike(r"^[0-9]+(\.[0-9]+)?[KMB]?$"), F.floor(n.try_cast("double") * factor + 0.5))


def low_audience(x, least: int = 30) -> Column:
    """SKIP below `least` subscribers; unknown numbers proceed."""
    n = subscribers(x)
    return F.when(n < least, "SKIP").otherwise("PROCEED")


def retrieval_shaped(x, most_words: int = 3, banned: str = r"(?i)\b(?:please|how to|what is|find me)\b") -> Column:
    """2 to 40 characters, few words, no prose."""
    t = F.trim(F.regexp_replace(col(x), r"\s+", " "))
    return F.coalesce((F.length(t).between(2, 40)) & (F.size(F.split(t, " ")) <= most_words) & ~t.rlike(banned), F.lit(False))


def script_compatible(x, allowed: list[str]) -> Column:
    """Whether every script of a text is among those allowed."""
    return F.forall(scripts(x), lambda s: s.isin(allowed))


#: Words that name nothing, and wording of sponsors, addresses and calls to follow.
GENERIC_WORDS = tuple("the and for that this with you your from have de da do com para uma por que em os as und mit das dem der die für ein eine einen les des dans pour sur une avec to my in on at by".split())
PROMOTION = (
    r"https?://", r"www\.", r"\.com|\.org|\.net|\.io|\.br|\.de|\.jp|\.uk", "code|cupom|discount|desconto|rabatt|promo", "instagram|telegram|whatsapp|twitter|facebook|tiktok|discord",
    "giveaway|sorteio|vlog|lifestyle|affiliate|patroc[ií]nio", "subscribe|channel|video|watch|like|follow|link|below|inscreva|canal|curta|abonnieren|abonnent",
)


def boilerplate(x, stopwords: tuple[str, ...] = GENERIC_WORDS) -> Column:
    """Nothing that a market calls by: under 2 or over 80 characters, all generic words, promotion, or a number of one or two digits."""
    t = F.coalesce(collapse(x), F.lit(""))
    return ~F.length(t).between(2, 80) | F.forall(F.split(t, " "), lambda w: w.isin(*stopwords)) | t.rlike("(?i)" + "|".join(PROMOTION)) | t.rlike("^[0-9]{1,2}$")


def query_variants(countries: DataFrame, templates: DataFrame) -> DataFrame:
    """Every template ({country} replaced) of a country's language, once (T31). Both inputs are small tables."""
    out = countries.join(templates, "language").withColumn("query", collapse(F.replace("template", F.lit("{country}"), F.col("country"))))
    return out.select("country", "language", "query").distinct()

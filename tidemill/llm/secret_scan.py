"""Secret scan: Boolean trigram queries against an inverted index choose the texts that each rule is run on.

DataFrame functions only. A rule whose matches must hold certain trigrams runs on the texts that its
query finds in the postings; a rule without such trigrams runs on every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise, text_or_empty

try:
    from re import _parser as sre
except ImportError:  # older interpreters
    import sre_parse as sre


@dataclass(frozen=True)
class Rule:
    """pattern: in the common syntax of Java and Python. least: code points that `group` must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, then those that this scan adds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
#: Strings that one part of a pattern is expanded to before its trigrams are taken.
EXPANSION = 64

Clause = frozenset  # of alternatives, each a frozenset of trigrams that must all be there


def _trigrams(s: str) -> frozenset:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _clause(strings: set[str]) -> list[Clause]:
    """What a match of one of the strings implies: all trigrams of some string; nothing if one is short."""
    sets = {_trigrams(s) for s in strings}
    if frozenset() in sets:
        return []
    return [frozenset(a for a in sets if not any(b < a for b in sets))]


class _Part:
    """exact: the strings that the part can be, or None; need: clauses that hold of any text with a match."""

    def __init__(self, exact: set[str] | None, need: list[Clause]):
        self.exact, self.need = exact, need


def _of_class(items) -> set[str] | None:
    chars: set[str] = set()
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            chars.add(chr(arg).lower())
        elif name == "RANGE" and arg[1] - arg[0] < 8:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return chars if len(chars) <= 8 else None


def _sequence(nodes) -> _Part:
    exact: set[str] | None = {""}
    whole, need = True, []
    for node in nodes:
        part = _node(node)
        if part.exact is not None and exact is not None and len(exact) * len(part.exact) <= EXPANSION:
            exact = {a + b for a, b in product(exact, part.exact)}
            continue
        whole = False
        need += _clause(exact) if exact else []
        need += part.need
        exact = part.exact if part.exact is not None else {""}
    return _Part(exact if whole else None, need if whole else [*need, *_clause(exact)])


def _node(node) -> _Part:
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return _Part({chr(arg).lower()}, [])
    if op == "IN":
        return _Part(_of_class(arg), [])
    if op == "SUBPATTERN":
        return _sequence(arg[-1])
    if op == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        if all(p.exact is not None for p in parts):
            return _Part(set().union(*(p.exact for p in parts)), [])
        ways = [p.need + (_clause(p.exact) if p.exact is not None else []) for p in parts]
        if all(ways):
            return _Part(None, [frozenset(a for w in ways for a in w[0])])
        return _Part(None, [])
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = arg
        part = _sequence(inner)
        if part.exact is not None and int(most) <= 1:
            return _Part(part.exact | {""} if least == 0 else part.exact, [])
        if part.exact is not None and least == int(most) and len(part.exact) ** least <= EXPANSION:
            return _Part({"".join(x) for x in product(part.exact, repeat=least)}, [])
        if not least:
            return _Part(None, [])
        return _Part(None, part.need + (_clause(part.exact) if part.exact is not None else []))
    return _Part(set() if op == "FAILURE" else {""} if op == "AT" else None, [])


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that hold of the lower-cased trigrams of any text with a match; none if nothing is implied."""
    part = _sequence(sre.parse(pattern))
    return part.need + (_clause(part.exact) if part.exact is not None else [])


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for way in clause for t in way})


def build_index(texts: DataFrame, trigrams: list[str] | None = None) -> DataFrame:
    """(key, text) -> postings (trigram, key), one for each distinct trigram of a text in lower case.

    With trigrams, only those are indexed: what a known set of rules can ask for. Without, all are.
    """
    if trigrams is not None and not trigrams:
        return texts.select(F.lit("").alias("trigram"), "key").where("false")
    low = F.lower("text")
    if trigrams is None:
        found = F.regexp_extract_all(low, F.lit(r"(?s)(?=(...))"), F.lit(1))
    else:
        starts = "".join(sorted({re.escape(t[0]) for t in trigrams}))
        ends = "".join(sorted({re.escape(t[1]) for t in trigrams}))
        found = F.regexp_extract_all(low, F.lit(f"(?=[{starts}][{ends}])(?=({'|'.join(map(re.escape, trigrams))}))"), F.lit(1))
    return texts.select("key", F.explode(F.array_distinct(found)).alias("trigram")).select("trigram", "key")


def _holds(have: str, need: list[Clause]) -> Column:
    every = lambda way: reduce(lambda a, b: a & b, [F.array_contains(have, t) for t in sorted(way)])
    some = lambda clause: reduce(lambda a, b: a | b, [every(w) for w in sorted(clause, key=sorted)])
    return reduce(lambda a, b: a & b, [some(c) for c in need])


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): texts whose trigrams satisfy the queries of rules that have one, postings intersected by key."""
    asked = [(r.kind, q) for r in rules if (q := trigram_query(r.pattern))]
    have = postings.groupBy("key").agg(F.collect_set("trigram").alias("have"))
    if not asked:
        return have.select("key", F.array().cast("array<string>").alias("kinds")).where("false")
    kinds = F.array_compact(F.array(*[F.when(_holds("have", q), F.lit(kind)) for kind, q in asked]))
    return have.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(rule: Rule, number: int) -> Column:
    """The rule's matches in text as (start, kind, end): what lies between matches gives where they are.

    Runs of one class are matched with their least length at once, which finds the same matches.
    """
    pattern = rule.pattern
    if rule.least and rule.group == 0 and re.fullmatch(r"(?:\[[^\]]+\]|\w+\[[^\]]+\])\+", pattern):
        pattern = pattern[:-1] + "{%d,}" % (rule.least - len(pattern[: pattern.index("[")]))
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    between = F.split("text", pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start: int, kind: int, end: int>>)").alias("out"))

    def step(s, x):
        a = s["at"] + F.length(x["b"])
        b = a + F.length(x["m"])
        return F.struct(F.coalesce(b, a).alias("at"), F.when(x["m"].isNull(), s["out"]).otherwise(F.array_append(s["out"], F.struct(a.alias("start"), F.lit(number).alias("kind"), b.alias("end")))).alias("out"))

    zipped = F.arrays_zip(between.alias("b"), found.alias("m"))
    spans = F.aggregate(zipped, start, step)["out"]
    if rule.least and pattern == rule.pattern:
        long_enough = F.transform(found, lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least)
        both = F.filter(F.arrays_zip(spans.alias("s"), long_enough.alias("k")), lambda x: x["k"])
        spans = F.transform(both, lambda x: x["s"])
    return F.when(F.col("text").rlike(pattern), spans).otherwise(F.expr("CAST(array() AS array<struct<start: int, kind: int, end: int>>)"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """doc_id and spans, an array of (start, kind, end) by start then rule, for each row of docs.

    kind is the rule's place from 0. Each rule's matches are leftmost and do not overlap; matches
    whose group is too short are dropped. Places count code points, the end is exclusive. Null and empty texts have no spans; each row of
    repeated ones has its own. An empty table gives no rows. Other columns are not looked at.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("key", F.xxhash64("text"))
    postings = build_index(texts.select("key", "text"), vocabulary(rules))
    chosen = materialise(candidates(postings, rules), "candidates")
    rows = texts.join(bounded(chosen), "key", "left")
    nothing = F.expr("CAST(array() AS array<struct<start: int, kind: int, end: int>>)")
    spans = [F.when(F.array_contains("kinds", r.kind), _spans(r, n)).otherwise(nothing) if trigram_query(r.pattern) else _spans(r, n) for n, r in enumerate(rules)]
    return rows.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def listed(spans: str, kinds: list[str], below: int) -> Column:
    """kind:start:end of the spans of the first `below` kinds, comma-joined."""
    name = F.array(*map(F.lit, kinds))
    own = F.filter(spans, lambda s: s["kind"] < below)
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of the default rules, for each row of docs."""
    kinds = [r.kind for r in BASE + ADDED]
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = {n})) AS long)").alias(f"n_{r.kind}") for n, r in enumerate(BASE)]
    return scan(docs).select("doc_id", *counts, F.sha2(listed("spans", kinds, len(BASE)), 256).alias("base_sha256"), listed("spans", kinds, len(kinds)).alias("spans"))


def oracle_sql() -> str:
    """DuckDB SQL for report(): every rule on every whole text."""
    parts = []
    for n, r in enumerate(BASE + ADDED):
        pattern = r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]").replace("'", "''")
        parts.append(f"SELECT id, {n} AS kind, '{r.kind}' AS name, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS g, string_split_regex(t, '{pattern}') AS b, {r.least} AS least FROM d WHERE regexp_matches(t, '{pattern}')")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents
), found AS (
  {" UNION ALL ".join(parts)}
), each AS (
  SELECT id, kind, name, unnest(m) AS w, unnest(g) AS own, unnest(b[1:len(m)]) AS gap, unnest(range(len(m))) AS i, least FROM found
), placed AS (
  SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY id, kind ORDER BY i) AS stop FROM each
), kept AS (
  SELECT id, kind, stop - length(w) AS start, name || ':' || (stop - length(w)) || ':' || stop AS s FROM placed WHERE length(own) >= least
), texts AS (
  SELECT id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(s, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans
  FROM kept GROUP BY id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN texts USING (id)
"""

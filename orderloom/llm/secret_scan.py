"""Secrets in texts: a trigram index narrows down which texts a rule is tried on.

From each rule's pattern a Boolean query over trigrams is derived that every match satisfies. The index holds, for
the trigrams that some query names, the postings (trigram, text); a rule's candidates come from combining them as
its query says, and only candidates are searched with the pattern itself. A rule without a mandatory trigram is
tried on every text, in the pass that makes the index. All of it is DataFrame functions.

A text is known by a 96-bit hash of its content, so equal texts are one entry of the index.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.llm.common import KEY, joined_to_texts, text_key, written

MANY = 64  # strings a part of a pattern may stand for before it is treated as anything


@dataclass(frozen=True)
class Rule:
    """A pattern (one that Java and Python read alike), and the group whose length must reach ``least``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True


# Fixed values.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}", base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", base=False),
)


# --- trigram queries --------------------------------------------------------------------------------------
# A query is a set of alternatives, each a set of trigrams that must all be there. None: no condition.

Query = frozenset[frozenset[str]] | None


def _slim(query: set[frozenset[str]]) -> Query:
    """Alternatives that ask for more than another one add nothing; an empty one makes it no condition."""
    least = frozenset(a for a in query if not any(b < a for b in query))
    return None if frozenset() in least else least


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _slim({x | y for x in a for y in b}) if len(a) * len(b) <= MANY else min(a, b, key=len)


def _either(a: Query, b: Query) -> Query:
    return None if a is None or b is None else _slim(set(a | b))


def _of_strings(strings: set[str]) -> Query:
    return _slim({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _parts(tokens) -> tuple[set[str] | None, Query]:
    """Of a sequence: the strings it stands for, if they are few, and a query that holds for every match."""
    run, query, whole = {""}, None, True
    for token in tokens:
        strings, inner = _part(token)
        if strings is not None and len(run) * len(strings) <= MANY:
            run = {a + b for a in run for b in strings}
            continue
        query, whole = _both(query, _of_strings(run)), False
        run = strings if strings is not None else {""}
        query = _both(query, inner)
    if whole:
        return run, _of_strings(run)
    return None, _both(query, _of_strings(run))


def _part(token) -> tuple[set[str] | None, Query]:
    kind, value = token
    if kind is ops.LITERAL:
        return {chr(value).lower()}, None
    if kind is ops.IN:
        chars = set()
        for inner, v in value:
            if inner is ops.LITERAL:
                chars.add(chr(v).lower())
            elif inner is ops.RANGE and v[1] - v[0] < 8:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if kind is ops.SUBPATTERN:
        return _parts(value[-1])
    if kind is ops.BRANCH:
        branches = [_parts(b) for b in value[1]]
        query = reduce(_either, (q for _, q in branches))
        if all(s is not None for s, _ in branches):
            strings = set().union(*(s for s, _ in branches))
            if len(strings) <= MANY:
                return strings, query
        return None, query
    if kind in (ops.MAX_REPEAT, ops.MIN_REPEAT):
        low, high, inner = value
        strings, query = _parts(inner)
        if strings is not None and high <= 2:
            out, now = ({""} if low == 0 else set()), {""}
            for n in range(1, int(high) + 1):
                now = {a + b for a in now for b in strings}
                out |= now if n >= low else set()
            if len(out) <= MANY:
                return out, None
        return None, query if low else None
    if kind is ops.AT:
        return {""}, None
    return None, None  # anything else asks for nothing


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams, one of which every match of the pattern has as a whole."""
    return _parts(parser.parse(pattern))[1]


# --- index ------------------------------------------------------------------------------------------------


def postings(texts: DataFrame) -> DataFrame:
    """(gram, k1, k2): which texts hold which trigrams, from the lists of those present."""
    return texts.select(F.explode("grams").alias("gram"), *KEY).distinct()


def _present(text: Column, grams: list[str]) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(k1, k2, kinds): the texts whose postings satisfy a rule's query, and the kinds of those rules."""
    grams = sorted({g for q in queries.values() for a in q or () for g in a})
    # Boolean work on posting lists as bits per text; long enough rule sets need more than one word of them.
    words = [grams[i : i + 60] for i in range(0, len(grams), 60)]
    bit = lambda part: reduce(
        lambda c, i: c.when(F.col("gram") == part[i], F.lit(1 << i).cast("long")), range(1, len(part)), F.when(F.col("gram") == part[0], F.lit(1).cast("long"))
    )
    masks = [F.bit_or(F.coalesce(bit(part), F.lit(0).cast("long"))).alias(f"m{n}") for n, part in enumerate(words)]
    found = index.groupBy(*KEY).agg(*masks)

    def holds(alternative: frozenset[str]) -> Column:
        tests = []
        for n, part in enumerate(words):
            mask = sum(1 << i for i, g in enumerate(part) if g in alternative)
            if mask:
                tests.append(F.col(f"m{n}").bitwiseAND(F.lit(mask)) == mask)
        return reduce(lambda a, b: a & b, tests)

    kinds = [
        F.when(reduce(lambda a, b: a | b, [holds(a) for a in sorted(q, key=sorted)]), F.lit(kind))
        for kind, q in queries.items()
        if q
    ]
    return found.select(*KEY, F.array_compact(F.array(*kinds)).alias("kinds")).filter(F.size("kinds") > 0)


def _matches(text: Column, rule: Rule) -> Column:
    """What the pattern matches, leftmost first and not overlapping: (gap before it, its length, whether it counts)."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    lengths = F.transform(found, lambda m: F.length(m))
    if rule.group:
        counted = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
    else:
        counted = F.transform(found, lambda m: F.length(m) >= rule.least)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), lengths.alias("n"), counted.alias("counts"))
    return F.when(F.size(found) > 0, zipped)


def _run_pattern(rule: Rule) -> str:
    """A pattern that is one repeated class can ask for its least length at once: its matches are whole runs."""
    m = _single_class(rule.pattern)
    return f"{m}{{{rule.least},}}" if m and not rule.group and rule.least else rule.pattern


def _single_class(pattern: str) -> str | None:
    return pattern[:-1] if pattern.startswith("[") and pattern.endswith("]+") and pattern.count("[") == 1 else None


def _spans(rows: DataFrame, kind: Column, matches: str) -> DataFrame:
    """(k1, k2, kind, start, end) from match lists; copies of a text are one."""
    each = rows.select(*KEY, kind.alias("kind"), F.posexplode(matches).alias("pos", "m"))
    each = each.select(*KEY, "kind", "pos", "m.gap", "m.n", "m.counts").distinct()
    upto = F.sum(F.col("gap") + F.col("n")).over(W.partitionBy(*KEY, "kind").orderBy("pos"))
    return each.withColumn("end", upto.cast("long")).filter("counts").select(
        *KEY, "kind", (F.col("end") - F.col("n")).alias("start"), "end"
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_<kind> of base rules, base_sha256, spans) for every row.

    Spans are ``kind:start:end`` by start, then in the order of the rules, comma-joined, in code points with the
    end exclusive; base_sha256 is over those of base rules. A NULL text is empty; equal rows have equal results;
    other columns are not read; an empty table gives an empty result.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in queries.values() for a in q or () for g in a})
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.select("doc_id", "text", *text_key(F.col("text")))
    unindexed = [r for r in rules if queries[r.kind] is None]
    full = [_matches(F.col("text"), Rule(r.kind, _run_pattern(r), r.group, r.least)).alias(f"at_{r.kind}") for r in unindexed]
    present = _present(F.col("text"), grams) if grams else F.array().cast("array<string>")
    known = written(slim.select("doc_id", *KEY, present.alias("grams"), *full), "trigrams")

    parts = [_spans(known.filter(F.col(f"at_{r.kind}").isNotNull()), F.lit(r.kind), f"at_{r.kind}") for r in unindexed]
    if grams:
        chosen = written(candidates(postings(known), queries), "candidates")
        tried = joined_to_texts(slim.select("text", *KEY), chosen)
        per_rule = [
            F.when(
                F.array_contains("kinds", r.kind),
                F.struct(F.lit(r.kind).alias("kind"), _matches(F.col("text"), r).alias("found")),
            )
            for r in rules
            if queries[r.kind] is not None
        ]
        tried = tried.select(*KEY, F.explode(F.array_compact(F.array(*per_rule))).alias("r")).filter("r.found IS NOT NULL")
        tried = tried.select(*KEY, F.col("r.kind").alias("kind"), F.col("r.found").alias("found"))
        parts.append(_spans(tried, F.col("kind"), "found"))
    spans = reduce(DataFrame.unionByName, parts)

    place = reduce(lambda c, i: c.when(F.col("kind") == rules[i].kind, i), range(1, len(rules)), F.when(F.col("kind") == rules[0].kind, 0))
    is_base = F.col("kind").isin([r.kind for r in rules if r.base])
    told = F.concat_ws(":", "kind", "start", "end")
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["told"]), ",")
    entry = F.struct("start", place.alias("place"), told.alias("told"))
    per_text = spans.groupBy(*KEY).agg(
        *[F.sum((F.col("kind") == r.kind).cast("long")).alias(f"n_{r.kind}") for r in rules if r.base],
        ordered(F.when(is_base, entry)).alias("base"),
        ordered(entry).alias("spans"),
    )
    out = known.select("doc_id", *KEY).join(per_text, list(KEY), "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{r.kind}", F.lit(0)).alias(f"n_{r.kind}") for r in rules if r.base],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )

"""Secret scan through a trigram inverted index, in DataFrame functions only.

Every rule's regular expression is turned into a Boolean query over trigrams that any match must
contain (OR of ANDs, derived from the parsed expression). One tokenising pass finds the trigrams that
some query names, in lower-cased text, and makes the inverted index: postings (trigram, document).
Postings meet the queries by trigram, the lists of a conjunction are intersected by document, and the
documents left are joined to their texts, where the expression itself is run. Rules without mandatory
trigrams scan every text in a pass of their own.

Documents travel as a 64-bit digest of id and text. Postings are a few small rows a document, distinct
before they are shuffled; texts move once, to meet the candidates, and those of a hot key are split by
adaptive execution. Positions are running sums over the exploded matches, so their cost is linear.

Defined cases: null text counts as empty; empty texts have no spans; long texts are scanned whole;
repeated rows each get their row; a null doc_id is passed through; an empty table gives an empty one;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import re._constants as sc
import re._parser as sp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key

#: Alternatives kept while literals are joined; more of them make a query useless and are given up.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlaps; a match stays if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


# The base kinds, and public formats of credentials.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + EXTRA

#: A query is None (anything matches) or a set of trigram sets: any one of them must be there in full.
Query = frozenset[frozenset[str]] | None


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    joined = _least(frozenset(x | y for x in a for y in b))
    return joined if len(joined) <= MAX_STRINGS else a


def _or(a: Query, b: Query) -> Query:
    return None if a is None or b is None else _least(a | b)


def _least(ways: frozenset[frozenset[str]]) -> frozenset[frozenset[str]]:
    """Without the ways that another one implies."""
    return frozenset(w for w in ways if not any(o < w for o in ways))


def _query_of(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _walk(parsed) -> tuple[Query, set[str] | None]:
    """(trigrams every match contains, all strings it can match if they are a short list)."""
    query, run, whole = None, {""}, True  # run: what the literals since the last gap can spell
    for op, arg in parsed:
        inner, exact = None, None
        if op is sc.LITERAL:
            exact = {chr(arg)}
        elif op is sc.AT:
            exact = {""}
        elif op is sc.IN and all(kind is sc.LITERAL for kind, _ in arg):
            exact = {chr(v) for _, v in arg}
        elif op is sc.SUBPATTERN:
            inner, exact = _walk(arg[-1])
        elif op is sc.BRANCH:
            ways = [_walk(p) for p in arg[1]]
            inner = ways[0][0]
            for other, _ in ways[1:]:
                inner = _or(inner, other)
            if all(e is not None for _, e in ways):
                exact = set().union(*(e for _, e in ways))
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
            low, high, body = arg
            once_query, once = _walk(body)
            inner = once_query if low else None
            if once is not None and high <= 3 and len(once) <= 4:
                exact = set()
                for n in range(low, high + 1):
                    spelled = {""}
                    for _ in range(n):
                        spelled = {a + b for a in spelled for b in once}
                    exact |= spelled
        if exact is not None and len(exact) * len(run) <= MAX_STRINGS:
            run = {a + b for a in run for b in exact}
            continue
        query, run, whole = _and(_and(query, _query_of(run)), inner), {""}, False
        if exact is not None:
            query = _and(query, _query_of(exact))
    return _and(query, _query_of(run)), run if whole else None


def trigram_query(rule: Rule) -> Query:
    """What trigrams a text must have for the rule to match; lower case if the rule ignores case."""
    query, _ = _walk(sp.parse(rule.pattern))
    if query is None or not rule.ignore_case:
        return query
    return frozenset(frozenset(t.lower() for t in way) for way in query)


def folded_query(rule: Rule) -> Query:
    """The rule's query as the index answers it, in lower case; it leaves no fewer candidates."""
    query = trigram_query(rule)
    return query and _least(frozenset(frozenset(t.lower() for t in way) for way in query))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def build_index(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, key) of the trigrams that the rules' queries name."""
    named = sorted({t for r in rules for way in folded_query(r) or () for t in way})
    if not named:
        return texts.select(F.lit("").alias("trigram"), "key").limit(0)
    found = F.filter(F.array(*map(F.lit, named)), lambda t: F.contains("folded", t))
    texts = texts.select("key", F.lower("text").alias("folded"))
    return texts.select("key", F.explode(found).alias("trigram")).distinct()


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kinds): documents on all lists of some conjunction of a rule's query."""
    asked = [
        (r.kind, n, t, len(way)) for r in rules for n, way in enumerate(sorted(folded_query(r) or (), key=sorted)) for t in sorted(way)
    ]
    queries = postings.sparkSession.createDataFrame(asked, "kind string, way int, trigram string, size int")
    met = postings.join(F.broadcast(queries), "trigram")  # a few rows a rule
    every = met.groupBy("key", "kind", "way", "size").agg(F.count("*").alias("n")).where("n = size")
    return every.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _matches(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, n, start, end, kept): matches of the rules in ``kinds`` over texts (key, text, kinds), in code points."""
    none = F.expr("cast(array() as array<struct<n: int, gap: int, m: string, kept: boolean>>)")

    def found_by(n: int, r: Rule) -> Column:
        found = F.regexp_extract_all("text", F.lit(r.java), F.lit(0))
        gaps = F.transform(F.split("text", r.java, -1), lambda t: F.length(t))
        kept = lambda m: F.length(F.regexp_extract(m, r.java, r.group)) >= r.least
        rows = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, gap: F.struct(F.lit(n).alias("n"), gap.alias("gap"), m.alias("m"), kept(m).alias("kept")))
        return F.when(F.array_contains("kinds", r.kind) & F.rlike("text", F.lit(r.java)), rows).otherwise(none)

    lists = [found_by(n, r) for n, r in enumerate(rules)]
    listed = texts.select("key", F.posexplode(F.concat(*lists)).alias("pos", "x"))
    till = F.sum(F.col("x.gap") + F.length("x.m")).over(Window.partitionBy("key", "x.n").orderBy("pos"))
    return listed.withColumn("end", till).where("x.kept").select("key", "x.n", (F.col("end") - F.length("x.m")).alias("start"), "end")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, indexed: bool = True) -> DataFrame:
    """doc_id and ``found``, an array of (start, n, end) with the rule's place n, in order; ``indexed=False`` scans for every rule."""
    texts = _texts(docs)
    with_query = tuple(r for r in rules if indexed and trigram_query(r) is not None)
    spans = None
    if with_query:
        left = candidates(build_index(texts, rules), with_query)
        met = texts.select("key", "text").join(left, "key").dropDuplicates(["key"])
        spans = _matches(met, rules)
    rest = [r for r in rules if r not in with_query]
    if rest:
        hit = F.array_compact(F.array(*(F.when(F.rlike("text", F.lit(r.java)), F.lit(r.kind)) for r in rest)))
        met = texts.select("key", "text", hit.alias("kinds")).where(F.size("kinds") > 0).dropDuplicates(["key"])
        scanned = _matches(met, rules)
        spans = scanned if spans is None else spans.unionByName(scanned)
    per = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "n", "end"))).alias("found"))
    none = F.expr("cast(array() as array<struct<start: bigint, n: int, end: bigint>>)")
    return texts.select("doc_id", "key").join(per, "key", "left").select("doc_id", F.coalesce("found", none).alias("found"))


def joined_spans(rules: tuple[Rule, ...], last: int) -> Column:
    """kind:start:end of the spans of the first ``last`` rules, by start and then in the order of the rules."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    told = F.transform(F.filter("found", lambda s: s["n"] < last), lambda s: F.concat_ws(":", F.get(kinds, s["n"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(told, ",")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, indexed: bool = True) -> DataFrame:
    """One row per document: doc_id, an array of spans (start, end) for each kind, base_spans and spans
    (joined); the rules begin with the base ones."""
    found = scan(docs, rules, indexed)

    def own(n: int) -> Column:
        return F.transform(F.filter("found", lambda s: s["n"] == n), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return found.select(
        "doc_id", *(own(n).alias(r.kind) for n, r in enumerate(rules)), joined_spans(rules, len(BASE)).alias("base_spans"), joined_spans(rules, len(rules)).alias("spans")
    )

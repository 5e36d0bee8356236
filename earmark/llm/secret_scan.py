"""Scan for secrets through a trigram index: only texts that hold a rule's mandatory trigrams are searched by its pattern.

Each rule's pattern is read once, on the driver, and turned into a Boolean query over trigrams of lower-cased text: alternatives of
sets that must all be there. The index has one row for each trigram of those queries that a text holds (a posting); trigrams that no
rule asks for are not indexed. Postings meet the queries in an equi-join on the trigram, and the alternatives whose trigrams are all
there name the candidates: (text, rule). Candidates are verified by the pattern; a rule without mandatory trigrams searches all texts.

All of it is DataFrame functions. A text goes by a hash of its id and itself, so two texts with one hash only share candidates, which
are verified. Postings are narrow rows, no list of a frequent trigram is gathered, and the queries are a table of some dozen rows.

Defined results: a null or empty text has no spans; a null id is an id like any other; repeated rows are kept; of spans that start at
one place, the rule listed first comes first; very long texts are searched whole; an empty table gives no rows; extra columns are not
read, so their names can't clash.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import keyed, lower_ascii, pin


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group whose length decides, and the least length."""

    kind: str
    pattern: str
    group: int
    least: int


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The published shapes of keys. Patterns mean the same in Java, Python and RE2.
_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
BASE = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    # {32,} finds the same as a run of any length that is dropped if it is shorter: what is left of a short run is shorter still.
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 0),
    Rule("hex", r"[0-9a-f]{32,}", 0, 0),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 0),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}", 0, 0),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
)
RULES = BASE + MORE

#: Strings that one stretch of a pattern may stand for, and alternatives of a query; beyond, the query asks for less.
_MOST = 64
#: A query: alternatives, each a set of trigrams that must all be there. One empty alternative asks for nothing.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _least(query: Query) -> Query:
    """Without alternatives that hold another one."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: Query, b: Query) -> Query:
    joined = _least(frozenset(x | y for x in a for y in b))
    return joined if len(joined) <= _MOST else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Query:
    """Texts that hold one of the strings."""
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _one(op, value) -> tuple[set[str] | None, Query]:
    """What one piece of a pattern stands for: all its strings, if they are few; else none, and the query that it implies."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}, ANY
    if name == "IN":
        found: set[str] = set()
        for kind, v in value:
            if str(kind) == "LITERAL":
                found.add(chr(v).lower())
            elif str(kind) == "RANGE" and v[1] - v[0] < 8:
                found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, ANY
        return found, ANY
    if name == "SUBPATTERN":
        return _sequence(value[-1])
    if name == "BRANCH":
        parts = [_sequence(p) for p in value[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*(strings for strings, _ in parts)), ANY
        return None, _least(frozenset().union(*(q if strings is None else _of_strings(strings) for strings, q in parts)))
    if name == "MAX_REPEAT":
        low, high, part = value
        strings, query = _sequence(part)
        if strings is not None and high == 1:
            return strings | {""} if low == 0 else strings, ANY
        return None, ANY if low == 0 else query if strings is None else _of_strings(strings)
    return None, ANY


def _sequence(pattern) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, ANY, True
    for op, value in pattern:
        strings, own = _one(op, value)
        if strings is not None and len(strings) * len(run) <= _MOST:
            run = {a + b for a, b in itertools.product(run, strings)}
            continue
        query = _both(_both(query, _of_strings(run)), own if strings is None else _of_strings(strings))
        run, whole = {""}, False
    return (run, ANY) if whole else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """Trigrams of the lower-cased text that each match of the pattern implies."""
    strings, query = _sequence(parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = keyed(docs, key, text).select(F.col("_c0").alias("id"), F.coalesce(F.col("_c1").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("row", F.xxhash64("id", "text"))


def postings(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: (trigram, row) for each of the trigrams that a lower-cased text holds."""
    folded = _texts(docs, key, text).select("row", lower_ascii(F.col("text")).alias("folded"))
    held = folded.select("row", F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams])).alias("held"))
    return held.select("row", F.explode_outer("held").alias("trigram")).filter(F.col("trigram").isNotNull()).distinct()


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(row, kinds): the rules whose query a text fulfils. Rules that ask for nothing are left out."""
    asked = [(kind, n, trigram, len(alternative)) for kind, query in queries.items() if query != ANY
             for n, alternative in enumerate(sorted(map(sorted, query))) for trigram in alternative]
    plan = index.sparkSession.createDataFrame(asked, "kind string, alternative int, trigram string, need int")
    held = index.join(F.broadcast(plan), "trigram").groupBy("row", "kind", "alternative", "need").agg(F.count(F.lit(1)).alias("n"))
    return held.filter("n = need").groupBy("row").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Array of (start, place, end) of a rule's matches; places in code points."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("before"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,place:int,end:bigint>>").alias("out"))

    def step(state: Column, m: Column) -> Column:
        first = state["at"] + F.char_length(m["before"])
        last = first + F.coalesce(F.char_length(m["match"]), F.lit(0))
        own = F.struct(first.alias("start"), F.lit(place).alias("place"), last.alias("end"))
        return F.struct(last.alias("at"), F.when(F.char_length(m["part"]) >= rule.least, F.concat(state["out"], F.array(own))).otherwise(state["out"]).alias("out"))

    return F.aggregate(found, start, step)["out"]


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a row of ``docs``: id, spans (start, place of the rule in ``rules``, end; sorted)."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() for a in q for t in a})
    texts = _texts(docs, key, text)
    found = texts.select("id", "text", F.array().cast("array<string>").alias("kinds"))
    if trigrams:
        index = pin(postings(docs, trigrams, key, text), "postings")
        named = pin(candidates(index, queries), "candidates")
        found = texts.join(named, "row", "left").select("id", "text", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint>>")
    own = []
    for place, rule in enumerate(rules):
        asked = F.array_contains("kinds", rule.kind) if queries[rule.kind] != ANY else F.col("text").rlike(rule.pattern)
        own.append(F.when(asked, _spans(F.col("text"), rule, place)).otherwise(none))
    return found.select("id", F.array_sort(F.concat(*own)).alias("spans"))

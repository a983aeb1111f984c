"""Secret scan: trigram queries derived from the rules' patterns choose what each pattern must read."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackwise.llm.common import any_names, fixed_rows, stored, without

# The rules' patterns. Letters of either case are spelt out, so that only A-Z and a-z count.
_KEYWORDS = (
    "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
)


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; where ``value_group`` is given, those whose
    group is shorter than ``value_length`` are dropped afterwards."""

    kind: str
    pattern: str
    value_group: int = 0
    value_length: int = 0


BASE_RULES = (
    Rule("assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # A run shorter than the least length holds no match that reaches it, so the length may stand in the pattern.
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

_MOST_ALTERNATIVES, _MOST_LETTERS = 128, 5


def _alternatives(parsed) -> list[tuple]:
    """What a parsed pattern can begin to look like: lower-case characters, None where anything may stand."""
    found: list[tuple] = [()]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            options = [(chr(arg).lower(),)]
        elif name == "IN":
            letters = {chr(x[1]).lower() for x in arg if str(x[0]) == "LITERAL"}
            plain = len(letters) <= _MOST_LETTERS and all(str(x[0]) == "LITERAL" for x in arg)
            options = [(c,) for c in sorted(letters)] if plain else [(None,)]
        elif name == "BRANCH":
            options = [a for branch in arg[1] for a in _alternatives(branch)]
        elif name == "SUBPATTERN":
            options = _alternatives(arg[-1])
        elif name == "MAX_REPEAT":
            least, most, inner = arg
            once = _alternatives(inner)
            if (least, most) == (0, 1):
                options = [(), *once]
            else:
                options = [(None,)] if least == 0 or len(once) > 1 else [once[0] * min(least, 3) + (None,) * (most > min(least, 3))]
        elif name == "AT":
            options = [()]
        else:
            options = [(None,)]
        if len(found) * len(options) > _MOST_ALTERNATIVES:
            options = [(None,)]
        found = [a + b for a, b in itertools.product(found, options)]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams: every match holds all trigrams of one clause. None: no trigram is mandatory."""
    clauses = set()
    for alternative in _alternatives(re._parser.parse(pattern)):
        grams = {"".join(g) for g in zip(alternative, alternative[1:], alternative[2:]) if None not in g}
        if not grams:
            return None
        clauses.add(frozenset(grams))
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def postings(docs: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """The inverted index, as far as a query asks for it: a row (``trigram``, ``key``) for each of ``trigrams`` in a text."""
    folded = docs.select(key, F.lower(text).alias("_folded"))
    there = F.array_compact(F.array(*[F.when(F.contains("_folded", F.lit(t)), F.lit(t)) for t in trigrams]))
    return folded.select(F.explode(there).alias("trigram"), key)


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str, text: str) -> DataFrame:
    """``key`` and the ``kinds`` whose trigram query the text meets, for rules that have a query."""
    asked = [(r.kind, i, g, len(c)) for r in rules for i, c in enumerate(trigram_query(r.pattern) or []) for g in sorted(c)]
    clauses = fixed_rows(docs.sparkSession, asked, ["kind", "clause", "trigram", "grams"])
    index = postings(docs, sorted({a[2] for a in asked}), key, text).distinct()
    met = index.join(clauses, "trigram").groupBy(key, "kind", "clause").agg(F.count("*").alias("_n"), F.first("grams").alias("_of"))
    return met.where(F.col("_n") == F.col("_of")).groupBy(key).agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Structs (start, number, stop) in code points: lengths of the pieces between matches and of the matches, summed."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.length(m).cast("long"))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value_group))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p).cast("long"))
    long_enough = F.transform(values, lambda v: F.length(v) >= rule.value_length)
    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), long_enough.alias("ok"))
    empty = F.array().cast("array<struct<start:long,number:int,stop:long>>")

    def step(state, x):
        start = state["at"] + x["gap"]
        stop = start + x["whole"]
        span = F.struct(start.alias("start"), F.lit(number).alias("number"), stop.alias("stop"))
        return F.struct(
            F.coalesce(stop, start).alias("at"),
            F.when(x["ok"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))
    return F.aggregate(steps, start, step, lambda s: s["spans"])


@any_names("text")
def scan_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``secrets``: an array of (kind, start, stop) by start, then by the rules' order; offsets in code points.

    From each rule's pattern a Boolean query over trigrams is derived. The postings of the queried
    trigrams are intersected clause by clause; only texts that meet a rule's query are given to its
    pattern. A rule without mandatory trigrams (long hex runs) reads every text. Postings are keyed
    by a 64-bit hash of the text: equal texts share a key, and a chance collision only makes one
    more text be verified. The key-to-kinds table is written to the shared folder, and Spark's size
    check decides how it joins the texts.

    A null text counts as empty and has no secrets. Repeated rows keep their number. Empty table:
    no rows. A column named ``secrets`` is replaced, all others kept.
    """
    numbers = {r.kind: i for i, r in enumerate(rules)}
    queried = tuple(r for r in rules if trigram_query(r.pattern))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = without(docs, ["secrets"]).withColumn("_key", F.xxhash64(body))
    slim = keyed.select("_key", body.alias("_text"))
    chosen = stored(candidates(slim, queried, "_key", "_text"), "secret-candidates") if queried else None
    rows = keyed.join(chosen, "_key", "left") if chosen is not None else keyed.withColumn("kinds", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:long,number:int,stop:long>>")
    each = []
    for rule in rules:
        due = F.array_contains("kinds", rule.kind) if rule in queried else F.lit(True)
        each.append(F.when(due & body.rlike(rule.pattern), _spans(body, rule, numbers[rule.kind])).otherwise(none))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    named = F.transform(F.array_sort(F.concat(*each)), lambda s: F.struct(
        F.element_at(kinds, s["number"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return rows.withColumn("secrets", named).select(*keyed.drop("_key").columns, "secrets")


def span_texts(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

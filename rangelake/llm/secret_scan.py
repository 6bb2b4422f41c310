"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: an OR of ANDs that every matching text
satisfies (letters folded to lower case). Postings ``(trigram, document)`` are built for the trigrams that the queries
name, intersected per clause by counting, and only the candidates are verified with the expression. Rules without a
mandatory trigram scan every text. Spans are counted in code points, end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op  # the names of the parsed nodes
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangelake.llm import packs


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds, leftmost and without overlap; a match counts when its group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# fixed values: the kinds that a digest counts
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Kinds that the scan adds.
MORE_RULES = (
    # to the END line with no other such line between; without one, over the armour's headers and the base64 lines
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
         r"(?:[^-]*(?:-{1,4}[^-]+){0,99}-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
         r"|(?:[\x20\t\r\n\\]+[A-Za-z][A-Za-z0-9-]{0,30}: [^\r\n]*){0,20}(?:[\x20\t\r\n\\]+[A-Za-z0-9+/=]{40,}){1,24}[A-Za-z0-9+/=\r\n\\]*)?"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Alternatives that are followed before a part counts as unknown.
_MOST = 64
_GAP = None


def _strings(nodes) -> list[tuple]:
    """The texts that a parsed expression can match, as sequences of characters and gaps (unknown parts)."""
    out: list[tuple] = [()]
    for kind, value in nodes:
        if kind is op.LITERAL:
            own = [(chr(value).lower(),)]
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            own = list({(chr(v).lower(),) for _, v in value})
        elif kind is op.SUBPATTERN:
            own = _strings(value[-1])
        elif kind is op.BRANCH:
            own = [s for branch in value[1] for s in _strings(branch)]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] == value[1] and value[0] <= 8:
            own = _strings(list(value[2]) * value[0])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[:2] == (0, 1):
            own = [(), *_strings(value[2])]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
            own = [s + (_GAP,) for s in _strings(value[2])]
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            own = [()]
        else:
            own = [(_GAP,)]
        if len(out) * len(own) > _MOST:
            own = [(_GAP,)]
        out = [a + b for a in out for b in own]
    return out


def trigram_query(pattern: str) -> list[list[str]]:
    """Clauses of trigrams: a text that matches holds, in lower case, all trigrams of some clause. Empty: no such query."""
    clauses: set[tuple[str, ...]] = set()
    for sequence in _strings(parser.parse(pattern)):
        runs = "".join("\n\n\n" if c is _GAP else c for c in sequence).split("\n\n\n")
        found = tuple(sorted({r[i : i + 3] for r in runs for i in range(len(r) - 2)}))
        if not found:
            return []
        clauses.add(found)
    # a clause that holds another one's trigrams adds nothing
    return [list(c) for c in sorted(clauses) if not any(set(d) < set(c) for d in clauses)]


def postings(docs: DataFrame, trigrams: list[str], key: str) -> DataFrame:
    """(trigram, key): the index over the given trigrams, of lower-cased texts. Rows stay with their task."""
    low = F.lower("text")
    present = F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return docs.select(key, low.alias("_low")).select(key, F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str) -> DataFrame:
    """(key, kinds): documents whose postings satisfy a clause of a rule's query."""
    rows = [(r.kind, n, t, len(c)) for r in rules for n, c in enumerate(trigram_query(r.pattern)) for t in c]
    named = sorted({t for _, _, t, _ in rows})
    # as many rows as the rules' queries have trigrams
    clauses = F.broadcast(docs.sparkSession.createDataFrame(rows, "kind string, clause int, trigram string, size int"))
    hits = postings(docs, named, key).join(clauses, "trigram").groupBy(key, "kind", "clause").agg(F.count_distinct("trigram").alias("n"), F.first("size").alias("size"))
    return hits.where("n = size").groupBy(key).agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, text: Column, order: int) -> Column:
    """start, order, end and kind of each counting match: what lies between the matches gives their places."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.split(text, rule.pattern, -1)
    pairs = F.zip_with(parts, found, lambda p, h: F.struct(F.char_length(p).alias("gap"), h.alias("hit")))
    placed = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,end:int,hit:string>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.coalesce(F.char_length(p["hit"]), F.lit(0))).alias("at"),
            F.when(p["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + p["gap"]).alias("start"), F.lit(order).alias("order"), (acc["at"] + p["gap"] + F.char_length(p["hit"])).alias("end"), p["hit"].alias("hit"),
            )))).alias("out"),
        ),
    )["out"]
    size = F.char_length if rule.group == 0 else lambda h: F.char_length(F.regexp_extract(h, rule.pattern, rule.group))
    return F.filter(placed, lambda s: size(s["hit"]) >= rule.least)


_EMPTY = "array<struct<start:int,order:int,end:int,hit:string>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` and ``_hits``: the counting matches (start, order, end, hit) by start, then rule.

    Null or empty texts have no matches. Rows with null or repeated ids are verified each on its own. An empty
    table gives an empty table.
    """
    keyed = docs.withColumn("_key", packs.document_key())
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    joined = keyed.join(candidates(keyed, indexed, "_key").withColumnRenamed("kinds", "_kinds"), "_key", "left") if indexed else keyed.withColumn("_kinds", F.array().cast("array<string>"))
    text = F.coalesce("text", F.lit(""))
    parts = []
    for n, rule in enumerate(rules):
        wanted = text.rlike(rule.pattern)
        if rule in indexed:
            wanted = F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False)) & wanted
        parts.append(F.when(wanted, _spans(rule, text, n)).otherwise(F.array().cast(_EMPTY)))
    return joined.withColumn("_hits", F.array_sort(F.concat(*parts))).drop("_key", "_kinds")


def _written(hits: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(hits, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    count = lambda n: F.size(F.filter("_hits", lambda s: s["order"] == n)).cast("long")
    base = F.filter("_hits", lambda s: s["order"] < len(BASE_RULES))
    return scan(docs.select("doc_id", "text"), rules).select(
        "doc_id", *(count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)),
        F.sha2(_written(base, rules), 256).alias("base_sha256"), _written(F.col("_hits"), rules).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The documents with every found span replaced, where spans overlap by one mark; columns as in ``docs``."""
    inner, names = packs.renamed(docs)
    found = scan(inner, rules)
    text = F.coalesce("text", F.lit(""))
    cut = F.aggregate(
        "_hits", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"),
        ),
    )
    found = found.withColumn("_cut", cut).withColumn("text", F.when(F.size("_hits") > 0, F.concat("_cut.out", F.substring(text, F.col("_cut.at") + 1, F.char_length(text)))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        own = names[docs.columns.index("n_chars")]
        found = found.withColumn(own, F.when(F.size("_hits") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own)))
    return packs.restored(found, docs, names)

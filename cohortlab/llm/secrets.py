"""Secret scan over a trigram inverted index (DataFrame functions only).

Each rule's regular expression gives a Boolean trigram query (``trigrams``). The
index holds postings (trigram, text key) for the trigrams that the rules name;
postings are intersected per alternative and only texts that satisfy a rule's
query are verified with its expression. Rules without a mandatory trigram scan
every text. The text key is a 64-bit hash: two texts that share one share their
candidate rules, which costs a verification and never a finding, as each row's
own text is verified.

Defined cases: a null text counts as empty; equal rows each get their row; other
columns pass through untouched, and clashing names are avoided; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import fresh, shielded, stage
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; a match counts if its
    group ``min_group`` has ``min_chars`` characters or more. ``scan`` is the
    pattern run by the engine where a stricter one gives the same matches. A ``whole``
    rule is redacted before the others, which could break up its matches."""
    kind: str
    pattern: str
    min_group: int = 0
    min_chars: int = 0
    scan: str | None = None
    whole: bool = False


# The patterns and lengths of the first three are fixed values. A greedy run that
# is too short holds no longer run, so access and hex take their length into the
# scanned pattern; assign must not (a failed match uses up its text).
# A private key runs from its BEGIN to its END line if no other dashed line (and no more
# than 64 hyphens, as in armor headers) stands between; else to the end of the base64 lines
# after BEGIN, of which there may be 1000. Loops over groups are bounded, as the engine recurses in them.
_KEY = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_SEP = r"""[\s\\>"'+|*#]{1,8}"""
KEY_BLOCK = (
    rf"-----BEGIN {_KEY}(?:[^-]*+(?:-(?!----)[^-]*+){{0,64}}+-----END {_KEY}"
    r"|(?:\r?\n[A-Za-z][A-Za-z-]{0,30}: [^\r\n]{0,200}){0,8}"
    rf"(?:{_SEP}[A-Za-z0-9+/]{{16,}}+={{0,2}}(?![A-Za-z0-9+/=._-])){{0,1000}}"
    rf"(?:{_SEP}[A-Za-z0-9+/]{{2,15}}(?:={{1,2}}(?![A-Za-z0-9+/=])|\Z))?(?:{_SEP}=[A-Za-z0-9+/]{{4}}(?![A-Za-z0-9+/=]))?)")
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16,}"),
    Rule("private_key", KEY_BLOCK, whole=True),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
MARK = "[REDACTED]"


def postings(docs: DataFrame, key: str, text: str, grams: list[str]) -> DataFrame:
    """The inverted index: one row for each trigram of ``grams`` in each text."""
    low = fresh(docs, "_low")[0]
    found = F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(F.col(low), g))
    return docs.select(key, F.lower(text).alias(low)).select(key, F.explode(found).alias("gram"))


def candidates(docs: DataFrame, key: str, text: str, rules) -> DataFrame:
    """(key, rules): indices of the rules whose trigram query the text satisfies."""
    wanted = [(g, i, a, len(grams)) for i, r in enumerate(rules)
              for a, grams in enumerate(trigram_query(r.pattern) or []) for g in sorted(grams)]
    if not wanted:
        return docs.select(key, F.array().cast("array<int>").alias("rules")).limit(0)
    index = postings(docs, key, text, sorted({w[0] for w in wanted}))
    queries = {}
    for g, i, a, n in wanted:
        queries.setdefault(g, []).append(F.struct(F.lit(i).alias("rule"), F.lit(a).alias("alt"), F.lit(n).alias("need")))
    terms = F.create_map(*[c for g, q in queries.items() for c in (F.lit(g), F.array(*q))])
    # a text's postings for one alternative meet under (key, rule, alt); copies of a text add none
    return (index.select(key, "gram", F.explode(F.element_at(terms, F.col("gram"))).alias("q"))
            .groupBy(key, "q.rule", "q.alt", "q.need").agg(F.collect_set("gram").alias("have"))
            .where(F.size("have") == F.col("need"))
            .groupBy(key).agg(F.collect_set("rule").alias("rules")))


def _pieces(text: Column, rule: Rule) -> Column:
    """array<struct<gap, hit, ok>>: the text cut at each match, in order. The
    last piece may have no hit."""
    pattern = rule.scan or rule.pattern
    cut = rf"(?s)(.*?)(?:({pattern})|\z)"
    both = F.regexp_extract_all(text, F.lit(cut), F.lit(1)), F.regexp_extract_all(text, F.lit(cut), F.lit(2))
    arrays = [*both]
    if rule.min_group:
        arrays.append(F.regexp_extract_all(text, F.lit(cut), F.lit(2 + rule.min_group)))
    return F.transform(F.arrays_zip(*[a.alias(n) for a, n in zip(arrays, ("gap", "hit", "group"))]), lambda p: F.struct(
        p["gap"], p["hit"],
        (F.length(p["group" if rule.min_group else "hit"]) >= max(rule.min_chars, 1)).alias("ok")))


def _spans(pieces: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, kind, end>> of the matches that count, in code points.

    Offsets come from two passes of running sums over blocks of 256 pieces, so a text
    with very many matches takes time in proportion."""
    width = 256
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    zero = F.lit(0).cast("long")
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"),
        F.when(p["ok"], F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + F.length(p["gap"])).alias("start"),
            (acc["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("end"))))).otherwise(acc["out"]).alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / width).cast("int")),
                         lambda b: F.aggregate(F.slice(pieces, b * width + 1, F.lit(width)),
                                               F.struct(zero.alias("at"), empty.alias("out")), step))
    joined = F.aggregate(blocks, F.struct(zero.alias("at"), F.array(empty).alias("out")), lambda acc, b: F.struct(
        (acc["at"] + b["at"]).alias("at"),
        F.concat(acc["out"], F.array(F.transform(b["out"], lambda s: F.struct(
            (s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"))))).alias("out")))["out"]
    return F.transform(F.flatten(joined), lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")))


def _to_verify(docs: DataFrame, text: str, rules) -> tuple[DataFrame, str, list]:
    """``docs`` with its candidate rules: (frame, column of them, a condition for each rule)."""
    key, mine = fresh(docs, "_key", "_rules")
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn(text, body).withColumn(key, F.xxhash64(body))
    # a table, so that Spark knows how few they are and moves no text to join them
    found = stage(candidates(keyed, key, text, rules).select(F.col(key).alias("_found"), F.col("rules").alias(mine)), "candidates")
    out = keyed.join(found, F.col(key) == F.col("_found"), "left").drop(key, "_found")
    ifs = [F.lit(True) if trigram_query(r.pattern) is None else
           F.coalesce(F.array_contains(F.col(mine), i), F.lit(False)) for i, r in enumerate(rules)]
    return out, mine, [c & F.col(text).rlike(r.scan or r.pattern) for c, r in zip(ifs, rules)]


def scan_secrets(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` (its null texts empty) plus ``secrets``: array<struct<start, ord, kind, end>>
    by start, then by the rules' order; code points, end exclusive."""
    docs, restore = shielded(docs, text)
    out, mine, verify = _to_verify(docs, text, rules)
    spans = fresh(out, *[f"_s{i}" for i in range(len(rules))])
    pieces = fresh(out, *[f"_p{i}" for i in range(len(rules))])
    none = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>")
    nothing = F.array().cast("array<struct<gap:string,hit:string,ok:boolean>>")
    out = out.withColumns({p: F.when(v, _pieces(F.col(text), r)).otherwise(nothing)
                           for p, v, r in zip(pieces, verify, rules)})
    out = out.withColumns({s: F.when(F.size(p) > 0, _spans(F.col(p), r, i)).otherwise(none)
                           for i, (s, p, r) in enumerate(zip(spans, pieces, rules))})
    return restore(out.withColumn("secrets", F.array_sort(F.concat(*[F.col(s) for s in spans])))
                   .drop(mine, *spans, *pieces))


def redact_secrets(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with each secret replaced by a mark, one rule after the other (``whole``
    ones first), each on the text that the former ones left. Texts without a secret stay as they are."""
    docs, restore = shielded(docs, text)
    was = fresh(docs, "_null")[0]
    out, mine, verify = _to_verify(docs.withColumn(was, F.col(text).isNull()), text, rules)
    piece = fresh(out, "_p")[0]
    for r, v in sorted(zip(rules, verify), key=lambda x: not x[0].whole):
        out = out.withColumn(piece, F.when(v, _pieces(F.col(text), r)))
        glue = F.array_join(F.transform(F.col(piece), lambda p: F.concat(
            p["gap"], F.when(p["ok"], F.lit(MARK)).otherwise(p["hit"]))), "")
        out = out.withColumn(text, F.when(F.col(piece).isNotNull(), glue).otherwise(F.col(text)))
    return restore(out.withColumn(text, F.when(~F.col(was), F.col(text))).drop(piece, mine, was))

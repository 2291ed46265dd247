"""Secret scan over a trigram inverted index.

Each rule's expression gives a Boolean query over trigrams. The index has a posting list
for every trigram that some query mentions; the lists are intersected and united as the
query says, and the candidates are verified with the expression. Rules without mandatory
trigrams are verified on every text.

The index names a text by its 64-bit hash, so copies share one posting and a clash can
only add a candidate, never lose one. Posting lists are cut into blocks of hashes, so a
trigram that most texts hold is never gathered in one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import save, sent_if_small, sha, text_key
from passagework.llm.trigrams import ALL, Query, trigram_query, trigrams_of
from passagework.operators.steps import settle

BLOCK_TEXTS = 65_536
MASK = "[SECRET]"
SPANS = "array<struct<s:int,o:int,e:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: expression, and the group that must have ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The first three rules.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # The same as runs of any length of which those under 32 are dropped.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE
# What lies between the parts of a key: white space, quotes and signs of quoted or joined strings, escaped line breaks.
_GAP = r"""(?:[ \t\r\n"'+,>#|]|\\+[nrt]?)"""
# Headers of an encrypted key, each on its line.
_HEADERS = r"(?:[ \t>]*+(?:[\r\n]|\\+[nr])++[ \t>]*+(?:Proc-Type|DEK-Info): ?[A-Za-z0-9,-]++)*+"
_LINES = rf"(?:{_GAP}*+[A-Za-z0-9+/=]{{16,}}+)++"
# The last line of a body is shorter and alone on its line, or ends in padding.
_LAST = (
    r"""(?:[ \t"'+,]*+(?:\r\n|[\r\n]|(?:\\+[nr])++)[ \t>#|"']*+[A-Za-z0-9+/=]++(?![ \t]*+[^ \t\r\n"'\\,])"""
    r"|[ \t]++[A-Za-z0-9+/]++={1,2}+)?+"
)
# The whole key: up to the END line, else through the body; a body begins with a line of 16 characters
# or more, of which fewer hold at most the key's fixed head and four bytes.
KEY = Rule("private_key", (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    rf"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----|{_HEADERS}{_LINES}{_LAST})?"
))
# Masking takes whole keys; the scan's own spans, as its SQL has them, are of the first line.
MASK_RULES = tuple(KEY if r.kind == KEY.kind else r for r in RULES)


def _posting(query: Query, lists: Column) -> Column:
    """The texts of a block that satisfy a query."""
    none = F.array().cast("array<bigint>")
    if isinstance(query, str):
        return F.coalesce(lists[query], none)
    parts = [_posting(q, lists) for q in query[1]]
    whole = parts[0]
    for part in parts[1:]:
        whole = F.array_intersect(whole, part) if query[0] == "and" else F.array_union(whole, part)
    return whole


def candidates(docs: DataFrame, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_key, rules): the texts, by hash, with the kinds whose trigram query they satisfy."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not ALL}
    grams = sorted(set().union(*map(trigrams_of, queries.values())))
    folded = docs.select(text_key(F.col(text)).alias("_key"), F.lower(F.col(text)).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams]))
    blocks = max(1, -(-docs.count() // BLOCK_TEXTS))
    index = save(
        folded.select("_key", F.explode(held).alias("gram"))
        .groupBy(F.pmod("_key", F.lit(blocks)).alias("block"), "gram")
        .agg(F.collect_set("_key").alias("posting")),
        "postings",
    )
    lists = index.groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.struct("gram", "posting"))).alias("lists")
    )
    matches = F.array(*[
        F.struct(F.lit(kind).alias("kind"), _posting(q, F.col("lists")).alias("texts"))
        for kind, q in queries.items()
    ])
    found = lists.select(F.explode(matches).alias("m")).select("m.kind", F.explode("m.texts").alias("_key"))
    return save(found.groupBy("_key").agg(F.collect_set("kind").alias("rules")), "candidates")


def _matches(rule: Rule, order: int) -> Column:
    """The rule's spans in ``_text``, leftmost first and without overlap, short ones dropped.

    The expression cuts the text into the pieces between its matches; lengths of pieces
    and matches add up to the positions.
    """
    java = rule.pattern.replace("(?i)", "")
    flag = "(?i)" if java != rule.pattern else ""
    text = F.col("_text")
    whole = F.regexp_extract_all(text, F.lit(f"{flag}({java})"), F.lit(1))
    judged = F.regexp_extract_all(text, F.lit(f"{flag}({java})"), F.lit(rule.group + 1))
    pieces = F.split(text, f"{flag}{java}")
    at = F.arrays_zip(
        F.transform(F.slice(pieces, F.lit(1), F.size(whole)), lambda x: F.length(x)).alias("gap"),
        F.transform(whole, lambda x: F.length(x)).alias("long"),
        F.transform(judged, lambda x: F.length(x)).alias("judged"),
    )
    empty = F.array().cast(SPANS)
    span = lambda acc, x: F.struct(
        (acc["end"] + x["gap"]).alias("s"), F.lit(order).alias("o"),
        (acc["end"] + x["gap"] + x["long"]).alias("e"), F.lit(rule.kind).alias("kind"),
    )
    return F.aggregate(
        at,
        F.struct(F.lit(0).alias("end"), empty.alias("spans")),
        lambda acc, x: F.struct(
            (acc["end"] + x["gap"] + x["long"]).alias("end"),
            F.when(x["judged"] >= rule.least, F.concat(acc["spans"], F.array(span(acc, x))))
            .otherwise(acc["spans"]).cast(SPANS).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def with_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "secrets") -> DataFrame:
    """Add ``name``: array of (s, o, e, kind), the spans of secrets by start, then rule order.

    Positions count code points, the end is exclusive. Spans of different kinds may
    overlap. Null and empty texts have no spans; every row, repeated or not, keeps its
    place; an empty table stays empty; the other columns are returned as they are.
    """
    for rule in rules:
        re.compile(rule.pattern)
    found = sent_if_small(candidates(docs, text, rules))
    inner = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
        F.coalesce(docs[text], F.lit("")).alias("_text"), text_key(docs[text]).alias("_key"),
    )
    marked = inner.join(found, "_key", "left")
    empty = F.array().cast(SPANS)
    parts = []
    for order, rule in enumerate(rules):
        wanted = (
            F.col("_text").rlike(rule.pattern) if trigram_query(rule.pattern) is ALL
            else F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))
        )
        parts.append(F.when(wanted, _matches(rule, order)).otherwise(empty).cast(SPANS))
    spans = F.array_sort(F.concat(*parts))
    return settle(marked.select("_row", "_text", "rules"), "_spans", spans).select(
        "_row.*", F.col("_spans").alias(name)
    )


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with every stretch that spans cover replaced by the mask."""
    start = F.struct(F.lit(0).alias("done"), F.array().cast("array<string>").alias("parts"))
    piece = lambda a, x: F.when(
        x["s"] >= a["done"],
        F.concat(a["parts"], F.array(F.substring(text, a["done"] + 1, x["s"] - a["done"]), F.lit(mask))),
    ).otherwise(a["parts"])
    return F.aggregate(
        spans, start,
        lambda a, x: F.struct(F.greatest(a["done"], x["e"]).alias("done"), piece(a, x).alias("parts")),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["done"] + 1, F.length(text))),
    )


def mask_secrets(
    docs: DataFrame, text: str = "text", chars: str = "n_chars", rules: tuple[Rule, ...] = MASK_RULES
) -> DataFrame:
    """The documents with their secrets masked and the character count, if there is one, renewed.

    Private keys are masked with their bodies, up to the END line or, where that is missing,
    as far as the body goes.
    """
    found = with_secrets(docs, text, rules, "_secrets")
    masks = F.when(F.size("_secrets") > 0, masked(F.col(text), F.col("_secrets"))).otherwise(F.col(text))
    done = settle(found, "_masked", masks)
    new = {text: F.col("_masked")}
    if chars in docs.columns:
        new[chars] = F.when(F.size("_secrets") > 0, F.length("_masked").cast(docs.schema[chars].dataType)).otherwise(F.col(chars))
    return done.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(
        spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))
    ), ",")


def digest(found: DataFrame, name: str = "secrets") -> DataFrame:
    """The contract's columns of ``with_secrets``."""
    of = lambda kind: F.size(F.filter(name, lambda x: x["kind"] == kind)).cast("long")
    base = F.filter(name, lambda x: x["o"] < len(BASE))
    return found.select(
        "doc_id", *[of(r.kind).alias(f"n_{r.kind}") for r in BASE],
        sha(listed(base)).alias("base_sha256"), listed(F.col(name)).alias("spans"),
    )

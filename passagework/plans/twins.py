"""SQL fragments that the twins of several queries share, written for DuckDB."""

from __future__ import annotations

# White space, punctuation, cleaning rules (below) and question words (below).
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
PUNCT = "'!\"#$%&'||chr(39)||'()*+,-./:;<=>?@['||chr(92)||']^_`{|}~'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def normalise(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), {PUNCT}, ''), '{WS}+', ' ', 'g'), ' ')"


def line_filter(x: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), "
        "lambda l: trim(l, ' ')), lambda l: length(l) > 3), chr(10))"
    )


def clean(x: str) -> str:
    """The cleaning rules; of all entities only those that the tables hold."""
    q = "''"
    # The same rules as in functions/markup.py, in this engine's syntax.
    steps = [
        (r"<[^>]+>", ""),
        # These names are also decoded when a page cuts off their semicolon.
        ("&middot;?", chr(0xB7)), ("&copy;?", chr(0xA9)), ("&quot;?", '"'), ("&lt;?", "<"),
        ("&gt;?", ">"), ("&amp;?", "&"),
        (r"\{\{[^}]*\}\}", ""),
        (r"\[\[([^|\]]+)\|([^\]]+)\]\]", r"\2"),
        (r"\[\[([^\]]+)\]\]", r"\1"),
        (rf"\[https?://[^\t-\r\x{{1c}}-\x{{20}}\x{{85}}\p{{Z}}\]]+{WS}+([^\]]+)\]", r"\1"),
        (r"\[https?://[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}\]]+\]", ""),
        (r"(?is)<ref[^>]*>.*?</ref>", ""),
        (r"(?i)<ref[^>]*/?>", ""),
        (r"(?i)\[\[File:[^\]]+\]\]", ""),
        (r"(?i)\[\[Image:[^\]]+\]\]", ""),
        (r"(?i)\[\[Category:[^\]]+\]\]", ""),
        (r"(?s)\{\|.*?\|\}", ""),
        (rf"={{2,}}{WS}*([^=]+){WS}*={{2,}}", r"\1"),
        (rf"{q}{{2,5}}([^{q}]+){q}{{2,5}}", r"\1"),
        (rf"\[{WS}*\]", ""),
        (rf"\({WS}*\)", ""),
        (rf"\n{WS}*\n", chr(10) * 2),
        (r"\n{3,}", chr(10) * 2),
        (r"[ \t]+", " "),
        (r"[ \t]*\n[ \t]*", chr(10)),
        (r"[^\P{C}\n\t]|[^\P{Z} ]", ""),
    ]
    for pattern, replacement in steps:
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return f"coalesce({strip(line_filter(x))}, '')"


def fixed_chunks(source: str, key: str, text: str, size: int = 1000, overlap: int = 50) -> str:
    """A select of (id, chunk_id, doc, chunk) over a table."""
    stride = size - overlap
    return f"""
      SELECT {key}::VARCHAR || '_' || i AS id, i::INT AS chunk_id, {key} AS doc,
             substring({text}, i * {stride} + 1, {size}) AS chunk
      FROM (SELECT {key}, {text},
                   unnest(range(0, greatest(length({text}) - {overlap} - 1, 0) // {stride} + 1)) AS i
            FROM {source})"""


def facts(x: str) -> str:
    return (
        f"list_transform(list_filter(string_split({x}, '.'), "
        f"lambda s: regexp_matches(s, '{NOT_WS}')), lambda s: {normalise('s')})"
    )


def keywords(x: str) -> str:
    # The question words.
    stop = "['what','when','where','who','why','how','is','are','was','were','do','does','did']"
    return (
        f"list_transform(list_filter({words(f'lower({x})')}, "
        f"lambda w: NOT list_contains({stop}, w) AND length(w) > 2), "
        f"lambda w: trim(w, {PUNCT}))"
    )


def citation(x: str, required: bool = True) -> str:
    found = rf"regexp_extract_all({x}, '\[([0-9]+)\]', 1)"
    return (
        f"CASE WHEN len({found}) = 0 THEN {str(not required).lower()} "
        f"ELSE len(list_filter({found}, lambda c: regexp_matches(c, '^0+$'))) = 0 END"
    )


def context_used(response: str, context: str) -> str:
    return (
        f"coalesce({context} <> '' AND len(list_filter(list_slice(string_split(lower({context}), "
        f"chr(10)||chr(10)), 1, 3), lambda b: contains(lower({response}), b))) > 0, false)"
    )


def complete(question: str, response: str) -> str:
    k = keywords(question)
    return (
        f"CASE WHEN len({k}) = 0 THEN true ELSE len(list_filter({k}, "
        f"lambda t: contains(lower({response}), t))) / len({k}) >= 0.6 END"
    )


def fact_f1_tables(rows: str, key: str, predicted: str, expected: str) -> str:
    """CTEs ``f1_scores(key, f1)``: fuzzy F1 by joining exploded facts, word set by word set."""
    word_set = "list_distinct(list_filter(string_split(f, ' '), lambda w: w <> ''))"
    return f"""
    f1_p AS (SELECT {key} AS k, i, {word_set} AS ws FROM (
               SELECT {key}, unnest({predicted}) AS f, generate_subscripts({predicted}, 1) AS i FROM {rows})),
    f1_e AS (SELECT {key} AS k, {word_set} AS ws FROM (SELECT {key}, unnest({expected}) AS f FROM {rows})),
    f1_m AS (SELECT k, count(*) AS m FROM f1_p p WHERE EXISTS (
               SELECT 1 FROM f1_e e WHERE e.k = p.k
                 AND len(list_intersect(p.ws, e.ws)) >= least(len(p.ws), len(e.ws)) * 0.5) GROUP BY k),
    f1_n AS (SELECT {key} AS k, len({predicted}) AS np, len({expected}) AS ne FROM {rows}),
    f1_scores AS (SELECT k AS {key}, CASE WHEN ne = 0 THEN (np = 0)::INT::DOUBLE WHEN np = 0 THEN 0.0
               WHEN coalesce(m, 0) = 0 THEN 0.0
               ELSE 2 * ((m / np) * (m / ne)) / ((m / np) + (m / ne)) END AS f1
             FROM f1_n LEFT JOIN f1_m USING (k))"""


ANSWERED_TURNS = """
  SELECT conv_id, turn, question, answer FROM (
    SELECT conv_id, turn, role, text AS question,
           lead(role) OVER o AS next_role, lead(text) OVER o AS answer
    FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant'"""

"""Registered queries of the corpus job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.markup import keep_long_lines
from passagework.operators.corpus import (
    boundary_chunks,
    clean_corpus,
    clean_markup,
    fixed_chunks,
    keep_long_texts,
)
from passagework.plans import twins
from passagework.plans.jobs import corpus_job
from passagework.plans.registry import query
from passagework.sources.tables import (
    first_rows,
    query_tables,
    read_parquet,
    save_table,
    spread,
    work_dir,
)


def _digest(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    return df.select(*keys, F.length(text).cast("long").alias("chars"), F.md5(text).alias("md5"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE length(text) >= 100")
def corpus_min_length(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents")
    return keep_long_texts(documents).select("doc_id", "lang", "source", "n_chars")


@query(
    "SELECT id, chunk_id, length(chunk) AS chars, md5(chunk) AS md5 FROM ("
    + twins.fixed_chunks("(SELECT * FROM documents WHERE length(text) >= 100)", "doc_id", "text")
    + ")"
)
def corpus_fixed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents").select("doc_id", "text")
    chunks = fixed_chunks(spread(keep_long_texts(documents), "doc_id"), "doc_id")
    return _digest(chunks, "id", "chunk_id", text="chunk")


@query(
    "SELECT lang, count(*) AS chunks, round(avg(length(chunk)), 6) AS mean_chars FROM ("
    + twins.fixed_chunks("(SELECT * FROM documents WHERE length(text) >= 100)", "doc_id", "text")
    + ") JOIN documents ON doc_id = doc GROUP BY lang"
)
def corpus_chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents").select("doc_id", "lang", "text")
    chunks = fixed_chunks(keep_long_texts(documents), "doc_id")
    return chunks.groupBy("lang").agg(
        F.count("*").alias("chunks"), F.round(F.avg(F.length("chunk")), 6).alias("mean_chars")
    )


@query(
    f"SELECT page_id, length(t) AS chars, md5(t) AS md5 FROM "
    f"(SELECT page_id, {twins.clean('html')} AS t FROM pages)"
)
def corpus_clean_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(read_parquet(spark, folder, "pages").select("page_id", "html"), "page_id")
    return _digest(clean_markup(pages, "html"), "page_id", text="html")


# One sample of every markup rule around the text of a document.
_MARKUP_BEFORE = (
    "== Heading ==\n{{box|a=1}}{| class=\"x\"\n|-\n| cell\n|}\n"
    "'''Bold''' and ''slanted'' [[Target|shown]] [[Plain link]] [https://x.org site name] "
    "[https://x.org] () [ ] &lt;ref name=a&gt;gone&lt;/ref&gt;&lt;ref/&gt; &amp;quot; "
    "[[[[File:x.jpg]]]] [[[[image:y.png]]]] [[[[Category:Z]]]] <b>tag</b><ref>kept</ref>\n\n\nab\n"
)
_MARKUP_AFTER = "\t \n{{a {{b}} c}} ​ end of text &copy; &middot;\n=== Next ===\n"


@query(
    f"SELECT doc_id, length(t) AS chars, md5(t) AS md5 FROM (SELECT doc_id, "
    + twins.clean(
        "('" + _MARKUP_BEFORE.replace("'", "''") + "' || text || '" + _MARKUP_AFTER + "')"
    )
    + " AS t FROM documents)"
)
def corpus_clean_injected(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(read_parquet(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    marked = F.concat(F.lit(_MARKUP_BEFORE), F.col("text"), F.lit(_MARKUP_AFTER))
    return _digest(clean_markup(documents.withColumn("text", marked)), "doc_id")


@query(
    f"SELECT doc_id, lang, length(t) AS chars, md5(t) AS md5 FROM "
    f"(SELECT doc_id, lang, {twins.clean('text')} AS t FROM documents) WHERE length(t) >= 100"
)
def corpus_clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents").select("doc_id", "lang", "text")
    return _digest(clean_corpus(spread(documents, "doc_id")), "doc_id", "lang")


@query(
    "SELECT doc_id, length(t) AS chars, md5(t) AS md5 FROM (SELECT doc_id, "
    + twins.line_filter(r"regexp_replace(text, '[ \t]+', ' ', 'g')")
    + " AS t FROM documents)"
)
def corpus_line_filter(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents").select("doc_id", "text")
    squeezed = F.regexp_replace("text", r"[ \t]+", " ")
    return _digest(documents.select("doc_id", keep_long_lines(squeezed).alias("text")), "doc_id")


def boundary_sql(source: str) -> str:
    """Pieces of (doc_id, text) by the boundary rule, one recursion step per piece."""

    def after(mark: str) -> str:
        found = f"strpos(reverse(w), {mark})"
        return (
            f"CASE WHEN {found} > 0 AND length(w) - {found} + 1 > 50 "
            f"THEN length(w) - {found} + 1 END"
        )

    lengths = ", ".join([after("chr(10)||chr(10)"), after("chr(10)"), after("' '")])
    tail = "substring(t, start + n - 50 + 1, 50)"
    first_break = (
        f"least(nullif(strpos({tail}, chr(10)), 0), nullif(strpos({tail}, ' '), 0))"
    )
    return f"""
    WITH RECURSIVE src AS ({source}),
    cuts AS (
      SELECT doc_id, 0 AS piece, 0 AS start, t, CASE WHEN length(t) <= 1000 THEN length(t)
             ELSE (SELECT coalesce({lengths}, 1000) FROM (SELECT substring(t, 1, 1000) AS w)) END AS n
      FROM src
      UNION ALL
      SELECT doc_id, piece, start, t, CASE WHEN length(t) - start <= 1000 THEN length(t) - start
             ELSE coalesce({lengths}, 1000) END AS n
      FROM (SELECT doc_id, piece + 1 AS piece, t, next AS start, substring(t, next + 1, 1000) AS w
            FROM (SELECT *, start + n - 50 + coalesce({first_break}, 50) AS next FROM cuts
                  WHERE start + n < length(t)))
    )
    SELECT doc_id::VARCHAR || '_' || piece AS id, piece::INT AS chunk_id, n AS chars,
           md5(substring(t, start + 1, n)) AS md5 FROM cuts"""


@query(boundary_sql("SELECT doc_id, text AS t FROM documents WHERE length(text) >= 100"))
def chunk_recursive(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents").select("doc_id", "text")
    chunks = boundary_chunks(spread(keep_long_texts(documents), "doc_id"), "doc_id")
    return _digest(chunks, "id", "chunk_id", text="chunk")


@query(
    boundary_sql(
        f"SELECT * FROM (SELECT doc_id, {twins.clean('text')} AS t FROM documents) WHERE length(t) >= 100"
    )
)
def corpus_job_chunks(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents").select("doc_id", "text")
    chunks = corpus_job(spread(documents, "doc_id"), "doc_id", work_dir(spark, "corpus"))[1]
    return _digest(chunks, "id", "chunk_id", text="chunk")


@query("SELECT source, count(*) AS articles, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def corpus_table_sql(spark: SparkSession, folder: str) -> DataFrame:
    saved = save_table(
        read_parquet(spark, folder, "documents").select("doc_id", "source", "text"),
        f"passagework_articles_{uuid.uuid4().hex}",
        work_dir(spark, "articles"),
    )
    return query_tables(
        spark,
        "SELECT source, count(*) AS articles, sum(length(text)) AS chars FROM {articles} GROUP BY source",
        articles=saved,
    )


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def corpus_first_rows(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return first_rows(documents, 100, "doc_id")

"""Registered queries of the index job: vectors, lookups and keeping the index in step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from passagework.operators.changes import (
    change_feed,
    duplicate_keys,
    index_status,
    index_upsert,
    snapshot_diff,
)
from passagework.operators import inverted
from passagework.operators.corpus import clean_corpus, fixed_chunks
from passagework.operators.vectors import knn_join, lookup, nearest_to, recall, write_index
from passagework.plans import twins
from passagework.plans.jobs import embed_words, sync_job
from passagework.plans.registry import query
from passagework.sources.tables import read_parquet, save_parquet, spread, work_dir

_EMBEDDED = """
  e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
  n AS (SELECT vec_id, label, v, list_inner_product(v, v) AS vv FROM e)"""
_PAIRS = """
  s AS (SELECT q.vec_id AS query_id, x.vec_id AS id, q.label AS q_label, x.label AS x_label,
               round(list_inner_product(q.v, x.v) / sqrt(q.vv * x.vv), 9) AS score
        FROM n q JOIN n x ON q.vec_id <> x.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_parquet(spark, folder, "embeddings"), "vec_id")


def _neighbours(vectors: DataFrame, **lookup) -> DataFrame:
    return knn_join(
        vectors, vectors, 5, query_id="vec_id", key="vec_id", vector="embedding",
        exclude_self=True, **lookup,
    )


@query(
    f"WITH {_EMBEDDED},{_PAIRS} SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score "
    "FROM r WHERE rank <= 5"
)
def knn_top5(spark: SparkSession, folder: str) -> DataFrame:
    found = _neighbours(_vectors(spark, folder))
    return found.withColumn("score", F.round("score", 6))


@query(
    f"WITH {_EMBEDDED},{_PAIRS} SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score "
    "FROM r WHERE rank <= 5"
)
def knn_top5_by_cells(spark: SparkSession, folder: str) -> DataFrame:
    found = _neighbours(_vectors(spark, folder), broadcast_queries=0, cells=16, block_rows=512)
    return found.withColumn("score", F.round("score", 6))


@query(
    f"WITH {_EMBEDDED}, q AS (SELECT v, vv FROM n WHERE vec_id = (SELECT min(vec_id) FROM n)) "
    "SELECT vec_id, label, round(score, 6) AS score FROM (SELECT vec_id, label, "
    "round(list_inner_product(q.v, n.v) / sqrt(q.vv * n.vv), 9) AS score FROM n, q) "
    "ORDER BY score DESC, vec_id LIMIT 5"
)
def knn_one_query(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_parquet(spark, folder, "embeddings")
    query_vector = vectors.orderBy("vec_id").first()["embedding"]
    found = nearest_to(vectors, query_vector, 5, key="vec_id", vector="embedding")
    return found.withColumn("score", F.round("score", 6))


@query(
    f"WITH {_EMBEDDED},{_PAIRS} SELECT q_label AS label, count(*) AS neighbours, "
    "sum((q_label = x_label)::INT)::BIGINT AS hits, round(avg((q_label = x_label)::INT), 6) AS hit_rate "
    "FROM r WHERE rank <= 5 GROUP BY q_label"
)
def knn_label_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    labels = vectors.select(F.col("vec_id"), "label")
    same = (F.col("label") == F.col("other")).cast("long")
    return (
        _neighbours(vectors)
        .join(labels.withColumnRenamed("vec_id", "query_id"), "query_id")
        .join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("other")), "id")
        .groupBy("label")
        .agg(
            F.count("*").alias("neighbours"),
            F.sum(same).alias("hits"),
            F.round(F.avg(same), 6).alias("hit_rate"),
        )
    )


_DIRECTED = """
  e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 NOT IN (3, 4, 5, 6, 7)),
  n AS (SELECT vec_id, 0 AS label, v, list_inner_product(v, v) AS vv FROM e)"""


@query(
    f"WITH {_DIRECTED},{_PAIRS}, top AS (SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM r "
    "WHERE rank <= 5) SELECT 'sent' AS way, * FROM top UNION ALL SELECT 'cells' AS way, * FROM top"
)
def knn_odd_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Null, zero, NaN, infinite and null-element vectors among the others, looked up in both ways."""
    kind, v = F.col("vec_id") % 50, F.col("embedding")
    first = lambda x: F.transform(v, lambda e, i: F.when(i == 0, F.lit(x).cast("float")).otherwise(e))
    odd = (
        F.when(kind == 4, F.transform(v, lambda e: F.lit(0.0).cast("float")))
        .when(kind == 5, first(float("nan")))
        .when(kind == 6, first(float("inf")))
        .when(kind == 7, first(None))
        .when(kind != 3, v)
    )
    vectors = _vectors(spark, folder).withColumn("embedding", odd)
    sent = _neighbours(vectors).withColumn("way", F.lit("sent"))
    cells = _neighbours(vectors, broadcast_queries=0, cells=16, block_rows=512).withColumn("way", F.lit("cells"))
    return sent.unionByName(cells).withColumn("score", F.round("score", 6))


_PROBED = f"""WITH {_EMBEDDED},{_PAIRS},
  p AS (SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) AS cell, v, vv FROM n WHERE vv > 0
        ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 32),
  d AS (SELECT n.vec_id, cell, list_inner_product(n.v, p.v) / sqrt(n.vv * p.vv) AS c FROM n, p WHERE n.vv > 0),
  home AS (SELECT vec_id, cell FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, cell) = 1),
  visit AS (SELECT vec_id, cell FROM d JOIN (SELECT DISTINCT cell FROM home) USING (cell)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, cell) <= 8),
  found AS (SELECT query_id, id FROM s JOIN home ON home.vec_id = s.id
            JOIN visit ON visit.vec_id = s.query_id AND visit.cell = home.cell
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5)
  SELECT count(*) AS neighbours, count(found.id) AS hits, count(found.id) / count(*) AS recall
  FROM (SELECT query_id, id FROM r WHERE rank <= 5) truth LEFT JOIN found USING (query_id, id)"""


@query(_PROBED)
def ann_recall(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    return recall(_neighbours(vectors, probes=8, cells=32), _neighbours(vectors))


@query(_PROBED)
def ann_stored_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The same from an index stored by cell, of which a lookup reads the cells it probes."""
    vectors = _vectors(spark, folder)
    root = work_dir(spark, "cells")
    write_index(vectors, root, 32, key="vec_id", vector="embedding")
    found = lookup(vectors, root, 6, 8, query_id="vec_id", vector="embedding")
    others = found.filter("id != query_id")
    best = Window.partitionBy("query_id").orderBy("rank")
    kept = others.withColumn("place", F.row_number().over(best)).filter("place <= 5")
    return recall(kept, _neighbours(vectors))


def _queries_and_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Every fiftieth vector as a query, and all vectors."""
    rows = _vectors(spark, folder).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), rows


@query()
def ann_quantised(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of a quantised index, the share of codes scanned and of full vectors compared."""
    queries, rows = _queries_and_rows(spark, folder)
    root = work_dir(spark, "quantised")
    now = inverted.build_index(rows, root, cells=32)
    listed, routed = inverted.shortlist(queries, root, probes=24, wanted=60, now=now)
    found = inverted.lookup(queries, root, 6, probes=24, wanted=60)
    truth = knn_join(queries, rows, 6)
    others = lambda df: df.filter("id != query_id")
    return inverted.with_effort(recall(others(found), others(truth)), routed, listed, now)


@query(
    "WITH cur AS (SELECT vec_id AS id, (CASE WHEN vec_id % 10 = 4 THEN list_reverse(embedding) ELSE embedding END)::DOUBLE[] AS v "
    "FROM embeddings WHERE vec_id % 10 <> 3 UNION ALL SELECT vec_id + 1000000, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 20 = 5), "
    "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS u FROM embeddings WHERE vec_id % 50 = 0), "
    "s AS (SELECT query_id, id, round(list_inner_product(u, v) / sqrt(list_inner_product(u, u) * list_inner_product(v, v)), 9) AS score "
    "FROM q, cur) SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER "
    "(PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5"
)
def index_incremental_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A stored index after rows were deleted, changed and added; its exact lookup equals that of a new one."""
    queries, rows = _queries_and_rows(spark, folder)
    root = work_dir(spark, "incremental")
    inverted.build_index(rows, root)
    change = lambda df, kind: df.select("id", "vector", F.lit(kind).alias("change_type"))
    changes = change(rows.filter("id % 10 = 3"), "delete").unionByName(
        change(rows.filter("id % 10 = 4").withColumn("vector", F.reverse("vector")), "update")
    ).unionByName(change(rows.filter("id % 20 = 5").withColumn("id", F.col("id") + 1_000_000), "insert"))
    inverted.apply_changes(changes, root)
    found = inverted.lookup(queries, root, 5)
    return found.withColumn("score", F.round("score", 6))


_WORD_SLOTS = f"""
  slots AS (SELECT doc_id, ('0x' || substring(md5(w), 1, 4))::INT % 64 AS slot, count(*) AS n
            FROM (SELECT doc_id, unnest(list_filter(string_split({twins.normalise('text')}, ' '),
                                        lambda w: w <> '')) AS w FROM documents)
            GROUP BY ALL)"""


@query(
    f"WITH {_WORD_SLOTS} SELECT doc_id, count(*) AS slots, sum(n)::BIGINT AS words, "
    "sum(n * slot)::BIGINT AS weighted, sum(n * n)::BIGINT AS squares FROM slots GROUP BY doc_id"
)
def embed_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(read_parquet(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    vectors = embed_words(documents, "text").select("doc_id", "vector")

    def total(values) -> F.Column:
        return F.aggregate(values, F.lit(0.0), lambda a, b: a + b).cast("long")

    doubles = F.transform("vector", lambda x: x.cast("double"))
    return vectors.select("doc_id", doubles.alias("v")).select(
        "doc_id",
        F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("slots"),
        total(F.col("v")).alias("words"),
        total(F.transform("v", lambda x, slot: x * slot)).alias("weighted"),
        total(F.transform("v", lambda x: x * x)).alias("squares"),
    ).filter("words > 0")


# The corpus as indexed earlier, and as re-chunked with new settings after cleaning.
_OLD = "(SELECT id, chunk FROM (" + twins.fixed_chunks("documents", "doc_id", "text") + "))"
_NEW = (
    "(SELECT id, chunk FROM ("
    + twins.fixed_chunks(
        f"(SELECT * FROM (SELECT doc_id, {twins.clean('text')} AS text FROM documents) "
        "WHERE length(text) >= 100)",
        "doc_id", "text", 800, 50,
    )
    + "))"
)


def _snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    root = work_dir(spark, "snapshots")
    documents = spread(read_parquet(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    old = fixed_chunks(documents, "doc_id").select("id", "chunk")
    new = fixed_chunks(clean_corpus(documents), "doc_id", size=800).select("id", "chunk")
    return save_parquet(old, f"{root}/old"), save_parquet(new, f"{root}/new")


@query(
    f"WITH o AS {_OLD}, n AS {_NEW} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL "
    "THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS change_type "
    "FROM o FULL OUTER JOIN n ON o.id = n.id "
    "WHERE o.id IS NULL OR n.id IS NULL OR o.chunk IS DISTINCT FROM n.chunk"
)
def index_diff(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _snapshots(spark, folder)
    return snapshot_diff(old, new, "id", ["chunk"])


@query(f"SELECT id, md5(chunk) AS md5 FROM {_NEW}")
def index_upsert_changes(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _snapshots(spark, folder)
    synced = index_upsert(old, change_feed(old, new, "id", ["chunk"]), "id")
    return synced.select("id", F.md5("chunk").alias("md5"))


@query(
    f"WITH c AS {_NEW}, w AS (SELECT id, ('0x' || substring(md5(w), 1, 4))::INT % 64 AS slot, count(*) AS n FROM "
    f"(SELECT id, unnest(list_filter(string_split({twins.normalise('chunk')}, ' '), lambda w: w <> '')) AS w FROM c) "
    "GROUP BY ALL), t AS (SELECT id, sum(n) AS words, sum(n * n) AS squares FROM w GROUP BY id) "
    "SELECT c.id, md5(chunk) AS md5, coalesce(words, 0)::BIGINT AS words, coalesce(squares, 0)::BIGINT AS squares "
    "FROM c LEFT JOIN t USING (id)"
)
def index_sync_job(spark: SparkSession, folder: str) -> DataFrame:
    """The stored index of the old chunks after only its changed chunks were embedded anew."""
    old, new = _snapshots(spark, folder)
    root = work_dir(spark, "sync")
    index = save_parquet(embed_words(old, "chunk"), f"{root}/index")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b).cast("long")
    v = F.transform("vector", lambda x: x.cast("double"))
    return sync_job(index, old, new, "id", "chunk", root).select(
        "id", F.md5("chunk").alias("md5"), total(v).alias("words"), total(F.transform(v, lambda x: x * x)).alias("squares")
    )


@query(f"SELECT id, count(*) AS copies FROM (SELECT id FROM {_OLD} UNION ALL SELECT id FROM {_NEW}) GROUP BY id HAVING count(*) > 1")
def index_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that a careless append of a new chunk table to the old one would have twice."""
    old, new = _snapshots(spark, folder)
    return duplicate_keys(old.unionByName(new), "id")


@query(
    f"WITH o AS {_OLD}, n AS {_NEW}, k AS (SELECT o.id AS oid, n.id AS nid FROM o FULL OUTER JOIN n "
    "ON o.id = n.id) SELECT count(nid) AS source_rows, count(oid) AS indexed_rows, "
    "count(*) FILTER (oid IS NULL) AS missing, count(*) FILTER (nid IS NULL) AS orphaned, "
    "count(*) FILTER (oid IS NULL OR nid IS NULL) = 0 AS ready FROM k"
)
def index_readiness(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _snapshots(spark, folder)
    return index_status(new, old, "id")

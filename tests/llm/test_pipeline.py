"""The pipeline stage by stage against plain versions, and its guards."""

import os
import re

import brute
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from passagework.llm import quality_rules, secrets
from passagework.llm.queries import multilingual


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "MinHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE",
    ]


def test_whole_run(spark, folder):
    read = lambda name: spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    docs, labels = read("documents"), read("labels")
    kept = {r["_id"] for r in quality_rules.judged(docs, labels).where("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept]
    first = {id for id, _, low in brute.near(rows) if id == low}
    rows = [r for r in rows if r[0] in first]
    items = [tuple(r) for r in read("benchmark").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute.contamination(rows, items) if r[5]}
    rows = [r for r in rows if r[0] not in dirty]
    tokens, pattern = multilingual()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    spans = {r["doc_id"]: r["secrets"] for r in secrets.with_secrets(docs).collect()}
    wanted = []
    for id, text in rows:
        out, end = [], 0
        for s in spans[id]:
            if s["s"] >= end:
                out += [text[end:s["s"]], secrets.MASK]
            end = max(end, s["e"])
        masked = "".join(out) + text[end:]
        assert not re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", masked)
        ids = library.encode_ordinary(masked)
        wanted.append((id, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(masked)))
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert 0 < len(dirty) and len(rows) < len(first) < len(kept) < docs.count()


def test_stages_keep_columns_and_empty_tables(spark, odd, folder):
    extra = odd.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))
    for table in (extra, extra.where(F.lit(False))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, table, folder)
            assert left.columns == table.columns
            assert left.count() <= table.count()

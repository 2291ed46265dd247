"""Secrets, trigram queries, quality rules and scores, addresses, components and archives."""

import glob
import gzip
import os
import re

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passagework.llm import quality_classifier, quality_rules, secrets, textstats, trigrams, urls, warc
from passagework.llm.graph import components

ASSIGN = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
TEXTS = [
    None, "", "x", 'é\U0001F600 token = "abcdefgh" and PASSWORD:short token: secret: abcdefghij',
    "AKIA" + "A" * 12 + " AKIA AKIAAKIA1234567890 xAKIAZZZZ", "0" * 31 + " " + "f" * 32 + "g" + "a1" * 40,
    "apikey='" + "z" * 9 + "' API_KEY=" + "q" * 7, "token=" + "0a" * 20, "-----BEGIN RSA PRIVATE KEY-----\nx",
    "passwordtoken==abcdefg1", "toKen\n: abcdefgh", "secret  :  \"abc.def-ghi/j+k=\"" * 40,
]


def spans(text):
    text, out = text or "", []
    for order, (kind, pattern, group, least) in enumerate((
        ("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32),
    )):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


def test_secrets_by_plain_matching(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, TEXTS[7], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rules string")
    found = secrets.with_secrets(docs)
    assert found.columns == [*docs.columns, "secrets"] and found.count() == len(rows)
    for row in found.collect():
        base = [tuple(s) for s in row["secrets"] if s["o"] < 3]
        assert base == spans(row["text"]), row["text"]
    digest = {(r["doc_id"], r["base_sha256"]) for r in secrets.digest(found).collect()}
    assert digest == {(i, brute.sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans(t)))) for i, t, _ in rows}
    assert secrets.with_secrets(docs.where(F.lit(False))).count() == 0


def test_masks(spark):
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_chars int")
    done = {r["doc_id"]: r for r in secrets.mask_secrets(docs).collect()}
    every = {r["doc_id"]: r["secrets"] for r in secrets.with_secrets(docs).collect()}
    for i, text in enumerate(TEXTS):
        wanted, end = [], 0
        for s in every[i]:
            if s["s"] >= end:
                wanted += [text[end:s["s"]], secrets.MASK]
            end = max(end, s["e"])
        assert done[i]["text"] == (None if text is None else "".join(wanted) + text[end:])
        assert done[i]["n_chars"] == len(done[i]["text"] or "")


def test_whole_keys_are_masked(spark):
    line = "MIIEpAIBAAKCAQEAx+/1" + "aB3" * 14 + "=="
    begin, end = "-----BEGIN {}PRIVATE KEY-----", "-----END {}PRIVATE KEY-----"
    body = "\n".join([line] * 5 + ["Zm9v+Q=="])
    keys = [f"{begin.format(k)}\n{body}\n{end.format(k)}" for k in ("", "RSA ", "ENCRYPTED ")]
    keys += [keys[1].replace("\n", "\r\n"), keys[1].replace("\n", "\\n"), keys[1].replace("\n", " "), keys[1].replace("\n", "\n> ")]
    keys.append(keys[1].replace("-----\n", "-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C\n\n", 1))
    keys += [k[:k.index("-----END")].rstrip("\\rn\r\n ") for k in keys[:5] + keys[-1:]] + [keys[0][:200], begin.format("") + "\n" + line * 20_000]
    keys += [f"{begin.format('')}\n{line * 20_000}\n{end.format('')}", keys[0].replace("\n", "\\\n"), begin.format("DSA ")]
    cases = [(f"see {k}\n\nand - so on", f"see {secrets.MASK}\n\nand - so on") for k in keys if not k.endswith(">")]
    cases.append((f"{keys[0]}\n{keys[1]} x", f"{secrets.MASK}\n{secrets.MASK} x"))
    cases.append((f"{begin.format('')} is how keys begin", f"{secrets.MASK} is how keys begin"))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    done = dict(secrets.mask_secrets(docs).collect())
    for i, (text, wanted) in enumerate(cases):
        assert done[i] == wanted, (i, text[:300], done[i][:300])
    of = {r.kind: trigrams.trigram_query(r.pattern) for r in secrets.RULES}
    assert of == {r.kind: trigrams.trigram_query(r.pattern) for r in secrets.MASK_RULES}
    assert secrets.with_secrets(docs).where("secrets[0].e - secrets[0].s > 40").count() == 0


def holds(query, text):
    if query is True:
        return True
    if isinstance(query, str):
        return query in text.lower()
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


@pytest.mark.parametrize("pattern, matching", [
    (ASSIGN, ["token=abcdefgh", "API_KEY : 'x", "passwd\"=\"q"]), (r"AKIA[A-Z0-9]+", ["AKIAX"]),
    (r"ab?cde+f{2}(gh|ij)*k", ["acdeffk", "abcdeeeffghijk"]), (r"(?:foo|ba[rz])qux$", ["fooqux", "bazqux"]),
    (r"a{4}b", ["aaaab"]), (r"x.yza", ["x-yza"]), (r"^[ab][cd]ef", ["adef"]),
])
def test_trigram_queries_lose_no_match(pattern, matching):
    query = trigrams.trigram_query(pattern)
    for text in matching:
        assert re.search(pattern, text) and holds(query, f"__{text}__")
    assert not holds(query, "nothing of that") or query is True


def test_patterns_without_trigrams():
    assert trigrams.trigram_query(r"[0-9a-f]{32,}") is True
    assert trigrams.trigram_query(r"a.b") is True
    assert trigrams.trigram_query(r"abc|x") is True
    few = trigrams.trigram_query(r"xox[abp]-")
    assert all(holds(few, f"..xox{c}-") for c in "abp") and not holds(few, "xoxc- xa- oxa xox")


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {t for t in tri if tri.count(t) > 1}
    covered = {i + j for i, t in enumerate(tri) if t in twice for j in range(3)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("text", [
    "", " \n ", "a b c a b c a b", "x\nx\n x\n\nx", "a\xa0b \x1cc\x85d", "# | <b> é é é é", "l1 a\nl1 a\nl2 b\n \n ", "q " * 30,
])
def test_counts(text):
    assert textstats.text_counts(text)[:5] == counts(text)


@pytest.fixture(scope="module")
def tables(spark, folder):
    read = lambda name: spark.read.parquet(os.path.join(folder, "..", "sf0.01", f"{name}.parquet"))
    return read("documents"), read("labels")


def quality_measures(found):
    """The measures again, in pandas, of a table of counts."""
    share = lambda a, b: np.where(found[b] > 0, found[a] / np.maximum(found[b], 1), 0.0)
    parts = {
        "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
        "repeats": ("n_repeat_words", "n_words"), "distinct": ("n_distinct", "n_words"), "capitals": ("n_upper", "n_chars"),
        "digits": ("n_digits", "n_chars"), "stops": ("n_stops", "n_words"), "marks": ("n_marks", "n_words"),
        "line_words": ("n_words", "n_lines"), "long_words": ("n_long", "n_words"),
    }
    return pd.DataFrame({"words": found.n_words.astype(float), **{name: share(*of) for name, of in parts.items()}})


def test_samples_are_bounded(spark):
    names = list(textstats.measures())
    rows = spark.range(20_000).select(
        F.col("id").alias("_id"), (F.col("id") % 2).cast("int").alias("_label"),
        *[(F.col("id") * (i + 3) % 101 / 101).alias(name) for i, name in enumerate(names)],
    )
    place = F.xxhash64("_id", *names)
    for most in (30_000, 20_000, 3_000, 10):
        wanted = [r[0] for r in rows.orderBy(place).limit(most).select("_id").collect()]
        assert textstats.sampled(rows, most)["_id"].tolist() == wanted
    assert len(textstats.sampled(rows.where("false"), 10)) == 0


def test_rules(tables, odd, empty):
    docs, labels = tables
    found = quality_rules.judged(docs, labels).toPandas()
    both = found.merge(labels.toPandas(), left_on="_id", right_on="doc_id")
    rules = both[~both.base_failed]
    assert ((rules.quality == 1) == rules.kept).mean() > 0.97
    assert rules[rules.quality == 1].kept.mean() > 0.98
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for row in found.head(200).itertuples():
        n, *rest, repeat = counts(texts[row._1] if hasattr(row, "_1") else texts[row[1]])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, *rest, repeat)
        assert row.base_failed == (n < 50 or 100 * repeat > 50 * n)
    data = {name: quality_measures(found)[name].to_numpy() for name in textstats.measures()}
    rules_found = quality_rules.learn(textstats.sampled(textstats.labelled(
        textstats.with_counts(docs), labels, "quality"), quality_rules.MOST_LABELLED))
    first = np.zeros(len(found), int)
    for number, rule in reversed(list(enumerate(rules_found, 1))):
        first[quality_rules._covers(rule, data)] = number
    assert len(rules_found) and (found.rule.fillna(0).to_numpy() == first).all()
    assert (found.kept == ~found.base_failed & (first == 0)).all()
    assert quality_rules.judged(odd, labels).count() == odd.count()
    assert quality_rules.judged(empty, labels).count() == 0
    none = quality_rules.judged(docs, labels.where(F.lit(False)))
    assert none.where("kept = base_failed").count() == 0
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == int(found.kept.sum())


def test_rules_are_learned_from_thresholds():
    random = np.random.default_rng(1)
    sample = pd.DataFrame({name: random.random(3000) for name in textstats.measures()})
    sample["_label"] = (~((sample.symbols > 0.8) & (sample.words < 0.5) | (sample.capitals > 0.9))).astype(int)
    rules = quality_rules.learn(sample)
    data = {name: sample[name].to_numpy() for name in textstats.measures()}
    marked = np.any([quality_rules._covers(r, data) for r in rules], axis=0)
    assert (marked == (sample._label == 0)).mean() > 0.98
    assert quality_rules.learn(sample[sample._label == 1]) == [] == quality_rules.learn(sample[:0])


def test_scores(tables, odd, empty):
    docs, labels = tables
    found = quality_classifier.scored(docs, labels).toPandas()
    both = found.merge(labels.toPandas(), left_on="_id", right_on="doc_id")
    held = both[both.held_out]
    assert len(held) > 50 and found.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() > 0.95
    ranks = held.score.rank()
    good = held.quality == 1
    area = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert area > 0.97
    assert quality_classifier.scored(odd, labels).count() == odd.count()
    assert quality_classifier.scored(empty, labels).count() == 0
    none = quality_classifier.scored(odd, labels.where(F.lit(False)))
    assert none.select("score").distinct().count() == 1
    # The same scores, recomputed plainly.
    counts = textstats.with_counts(docs).toPandas()
    rows = textstats.labelled(textstats.with_counts(docs), labels.where(~quality_classifier.held_out(F.col("doc_id"))), "quality")
    ranking = quality_classifier.fit(textstats.sampled(rows, quality_classifier.MOST_LABELLED))
    of = lambda table: sum(
        ranking.weights[name][np.searchsorted(ranking.cuts[name], table[name].to_numpy(), "right")] for name in textstats.measures()
    )
    learned = rows.toPandas()
    totals, share = of(learned), (learned._label == 0).mean()
    middle = np.quantile(totals, share)
    plain = 1 / (1 + np.exp(-((of(quality_measures(counts)) - middle) * 2 / totals.std() + np.log(0.3 / 0.7))))
    wanted = dict(zip(counts["_id"], plain))
    assert all(abs(wanted[i] - score) < 1e-9 for i, score in zip(found["_id"], found.score))
    assert set(found.predicted) == {0, 1} and ((found.score >= 0.3) == (found.predicted == 1)).all()
    # Held-out labels change nothing.
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_classifier.scored(docs, turned).toPandas()
    assert again.sort_values("_id").score.tolist() == found.sort_values("_id").score.tolist()


LINK = '<link rel="canonical" href="{}">'
REFRESH = '<META http-equiv=refresh content="0; URL={}">'


def url_table(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c") for r in rows], "page_id long, url string, html string, host string, node string, component string")


def test_addresses(spark):
    rows = [
        (1, "http://A.example.org/es/1", None), (2, "http://x.net/p", REFRESH.format("http://y.net/q")),
        (3, "http://y.net/q#z", LINK.format("https://w.b.com/de/5")), (4, "https://b.com/de/5/", ""),
        (5, "http://b.com/fr/1", LINK.format("http://x.net/p")), (6, None, None), (7, "no scheme", LINK.format("/x")),
        (8, "http://org/", None), (9, "http://org?x", None), (10, "https://X.net:443/p", None), (11, "http://z.net/a", None),
        (None, "http://x.net/p", None), (2, "http://x.net/p", REFRESH.format("http://y.net/q")), (12, "http://Example.ORG/en/1/x", None),
        (13, "http://notexample.org/es/", None), (14, "ftp://u@h:80//a://b", None), (15, "http://x.net/p?q", None), (16, "http://www.x.net/p", None),
        (None, None, None), (6, None, None),
    ]
    pages = url_table(spark, rows)
    found = {}
    for r in urls.judged(pages).collect():
        found.setdefault(r["_id"], []).append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert found[1] == [("a.example.org", "/es/1", "example.org/es/", "block")]
    assert found[2] == [("x.net", "/p", None, "block")] * 2
    assert found[3] == [("y.net", "/q", None, "block")]
    assert found[4][0][2:] == ("com/de/", "block")
    assert found[5][0][2:] == ("com/fr/", "allow")
    assert found[6] == [("", "", None, "allow")] * 2 and found[7] == [("", "", None, "allow")]
    assert found[8][0][2:] == ("org/", "allow") and found[9] == [("org", "", None, "allow")]
    assert found[10] == [("x.net:443", "/p", None, "block")]
    assert sorted(found[None]) == [("", "", None, "allow"), ("x.net", "/p", None, "block")]
    assert found[11][0][3] == found[15][0][3] == found[16][0][3] == "allow"
    assert found[12][0] == ("example.org", "/en/1/x", "example.org/en/1", "block")
    assert found[13][0][2] == "org/" and found[14][0][:2] == ("u@h:80", "//a://b")
    more = spark.createDataFrame([("http://z.net/a", "http://b.com/de/5")], "a string, b string")
    assert urls.judged(pages, redirects=more).where("_id = 11").first()["verdict"] == "block"
    assert urls.judged(pages.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("page, html, verdict", [
    ("http://a.net/p", REFRESH.format("http://b.com/de/1"), "block"),  # the target itself was not fetched
    ("http://a.com/q/p", LINK.format("../de/z.html"), "block"),
    ("http://a.com/de2/p", LINK.format("./../de/./x/../z?y#t"), "block"),
    ("http://a.com/de2/p", LINK.format("..//de/z"), "allow"),  # an empty segment is a segment
    ("http://a.com/q/p", LINK.format("/../../de/"), "block"),
    ("http://a.net", LINK.format("//b.com/de/1"), "block"),
    ("http://a.net/q/p", LINK.format("javascript:x"), "allow"),
    ("http://a.net/q/p", LINK.format("b.com/de/1"), "allow"),
    ("http://a.org/q", LINK.format("http://b.com/de/1"), "allow"),  # its own rule allows it
])
def test_link_targets(spark, page, html, verdict):
    assert urls.judged(url_table(spark, [(1, page, html)])).first()["verdict"] == verdict


def test_queries_are_other_pages(spark):
    rows = [
        (1, "http://h.net/v?id=1", LINK.format("http://b.com/de/1")), (2, "http://h.net/v?id=2", None), (3, "http://h.net/v", None),
        (4, "http://h.net/w", LINK.format("?id=1")), (5, "http://h.net/w?id=1", LINK.format("/v?id=1")), (6, "http://h.net/z", LINK.format("v?id=1")),
    ]
    found = {r["_id"]: r["verdict"] for r in urls.judged(url_table(spark, rows)).collect()}
    assert found == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block"}


def test_dot_segments(spark):
    wanted = {"": "/", "/": "/", "/a/./b": "/a/b", "/a/../b": "/b", "/a/..": "/", "/../a": "/a", "/a/b/.": "/a/b/", "/a/...": "/a/...", "/.a": "/.a", "//a/..": "//"}
    rows = spark.createDataFrame([(p,) for p in wanted], "p string").select("p", urls.resolved(F.col("p")).alias("r")).collect()
    assert {r["p"]: r["r"] for r in rows} == wanted


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    wanted = {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 300, 301: 300}
    assert found == wanted


def test_archives(spark, folder, tmp_path):
    pages = spark.read.parquet(os.path.join(folder, "pages.parquet"))
    odd = spark.createDataFrame(
        [(None, None, None), (3, "http://x\r\n/y", "a\r\n\r\nWARC/1.1\r\nb"), (3, "http://x", "é" * 900), (3, "http://x", "é" * 900)],
        pages.select("page_id", "url", "html").schema,
    )
    own = warc.records(
        pages.select("page_id", "url", "html").union(odd), archive_bytes=30_000
    )
    place = str(tmp_path / "files")
    warc.write_archives(own, place)
    listed = warc.leaves(own).orderBy("archive", "ordinal").collect()
    read = warc.read_archives(spark, place)
    assert [tuple(r) for r in read.orderBy("archive", "ordinal").collect()] == [tuple(r) for r in listed]
    assert len({r["archive"] for r in listed}) > 3
    assert warc.audit(warc.leaves(own), read, fanout=3).count() == 0
    # Spoil a byte in one file, cut the end off another, lose a third.
    files = sorted(glob.glob(f"{place}/archive=*/*.gz"))
    data = gzip.open(files[0]).read()
    at = data.rindex(b"\r\n\r\n", 0, len(data) - 4) + 4
    with gzip.open(files[0], "wb") as file:
        file.write(data[:at] + b"#" + data[at + 1:])
    with open(files[1], "rb") as file:
        stored = file.read()
    with open(files[1], "wb") as file:  # the compressed stream itself is damaged
        file.write(stored[:len(stored) // 2] + b"\xff\x00\xff" + stored[len(stored) // 2 + 3:])
    for path in glob.glob(os.path.dirname(files[2]) + "/*") + glob.glob(os.path.dirname(files[2]) + "/.*"):
        os.remove(path)
    for path in glob.glob(f"{place}/archive=*/.*.crc"):
        os.remove(path)
    now = warc.read_archives(spark, place)
    before = {(r["archive"], r["ordinal"]): r["digest"] for r in listed}
    after = {(r["archive"], r["ordinal"]): r["digest"] for r in now.collect()}
    wanted = {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
    found = {(r["archive"], r["ordinal"]): r["fault"] for r in warc.audit(warc.leaves(own), now, fanout=3).collect()}
    assert set(found) == wanted and "missing" in found.values() and "changed" in found.values()
    nothing = warc.records(pages.where(F.lit(False)).select("page_id", "url", "html"))
    assert warc.audit(warc.leaves(nothing), warc.leaves(nothing)).count() == 0


def test_archives_of_one_repeated_page(spark, tmp_path):
    rows = [(7, "http://x", "same" * 50)] * 400 + [(None, None, f"{i * 7919 % 401:03} " * 60) for i in range(400)]
    rows += [(i, f"http://y/{i}", "é" * (i % 300)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    own, place = warc.records(pages, archive_bytes=40_000), str(tmp_path / "files")
    listed, archives = own.orderBy("archive", "ordinal").collect(), {}
    for r in listed:
        archives.setdefault(r["archive"], []).append(r)
    assert len(listed) == len(rows) and len(archives) > 5
    for found in archives.values():
        order = sorted(found, key=lambda r: (r["_id"] is not None, r["_id"] or 0, r["record"].encode()))
        assert [r["record"] for r in order] == [r["record"] for r in found]
        assert [r["ordinal"] for r in found] == list(range(len(found)))
        at = 0
        for r in found:
            assert (r["start"], r["long"]) == (at, len(r["record"].encode()))
            at += r["long"] + 4
    ranged = warc._ranged(pages, "page_id", "url", "html", 40_000).groupBy("_range").count().toPandas()
    assert len(ranged) > 5 and ranged["count"].max() < 400
    warc.write_archives(own, place, file_bytes=20_000)
    files = glob.glob(f"{place}/archive=*/*.gz")
    assert max(len(gzip.open(f).read()) for f in files) <= 20_000 + max(r["long"] for r in listed) + 4
    read = warc.read_archives(spark, place).orderBy("archive", "ordinal")
    assert [tuple(r) for r in read.collect()] == [tuple(r) for r in warc.leaves(own).orderBy("archive", "ordinal").collect()]
    # A lost piece is missed, and what follows it is not taken for changed.
    lost = next(f for f in files if re.search("archive=[0-9]+_1_", f))
    for path in (lost, os.path.join(os.path.dirname(lost), f".{os.path.basename(lost)}.crc")):
        os.remove(path)
    faults = warc.audit(warc.leaves(own), warc.read_archives(spark, place)).select("fault").distinct().collect()
    assert [r[0] for r in faults] == ["missing"]

"""Pages, vectors and the pipeline."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest

from cinderlog.llm import ann, queries, url_filter
from cinderlog.llm.stages import drop, shared_dir, stage

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, host string, verdict string"


def _judge(spark, urls, html=None):
    pages = spark.createDataFrame([(i, u, (html or {}).get(i), "h", "v") for i, u in enumerate(urls)], PAGES)
    return {r["page_id"]: r for r in url_filter.judge(pages).collect()}


def test_rules_and_parts(spark):
    urls = [
        "https://A.Example.COM/en/x?q#f", "http://www.example.com/en/1", "http://x.net/es/a", "http://x.net/esx", "http://notexample.com/en/", "http://example.com", None, "no scheme", "a://b://c/d",
        "http://h.org/p?x://y", "http://www.example.com/en/1",
    ]
    got = _judge(spark, urls)
    assert [(got[0][k]) for k in ("host", "path", "rule", "verdict")] == ["a.example.com", "/en/x", "example.com/en/", "block"]
    assert (got[1]["rule"], got[1]["verdict"]) == ("www.example.com/en/", "allow") and got[10]["verdict"] == "allow"
    assert (got[2]["rule"], got[2]["verdict"]) == ("net/es/", "block") and got[3]["rule"] is None
    assert got[4]["rule"] == "com/" and (got[5]["path"], got[5]["rule"]) == ("", None)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in (6, 7)] == [("", "", None, "allow")] * 2
    assert (got[8]["host"], got[8]["path"]) == ("b:", "//c/d") and (got[9]["host"], got[9]["path"]) == ("h.org", "/p")


def test_trust_follows_links_and_distrust_goes_back(spark):
    urls = ["http://good.com/a", "http://bad.net/es/x", "http://liked.org/a", "http://linker.org/b", "http://alone.org/c"]
    html = {0: '<a href="http://LIKED.org/z">', 3: '<A HREF = \'https://bad.net/es/y\'> <a href=/local>'}
    got = _judge(spark, urls, html)
    assert got[2]["trust"] > 0 == got[2]["distrust"] and got[2]["verdict"] == "allow"
    assert got[3]["distrust"] > 0 and got[3]["verdict"] == "block" and got[4]["verdict"] == "allow"


def test_verdicts_do_not_depend_on_the_number_of_other_pages(spark):
    rows = [(i, f"http://linker{i}.org/", '<a href="http://bad.net/es/y">', "h", "v") for i in range(1000)] + [(1000, "http://bad.net/es/x", None, "h", "v")]
    pages = spark.createDataFrame(rows, PAGES)
    others = spark.range(2000, 402_000).selectExpr("id", "'http://other.org/a'", "cast(null as string)", "'h'", "'v'")
    for table in (pages, pages.union(others)):
        got = url_filter.judge(table).where("page_id < 2000 or page_id = 2000").groupBy("host", "verdict").count().collect()
        assert {r["verdict"] for r in got if r["host"].startswith("linker")} == {"block"} and all(r["verdict"] == "allow" for r in got if r["host"] == "other.org")


def test_no_pages(spark):
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, codes string, score double")


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[100:600] = x[100]  # many equal vectors: ties
    rows = [(i, v.tolist(), 0, "c", 0.0) for i, v in enumerate(x)]
    rows += [(3100, None, 0, "c", 0.0), (3200, [0.0] * 24, 0, "c", 0.0), (3300, [float("nan")] * 24, 0, "c", 0.0), (3400, [1.0] * 5, 0, "c", 0.0), (3500, [None] * 24, 0, "c", 0.0), (None, x[0].tolist(), 0, "c", 0.0)]
    got = ann.nearest(_vectors(spark, rows)).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 3000, 100))
    hits = 0
    for q, found in by.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hits += len(set(best) & {v for v, _ in found})
        assert all(abs(s - d[v]) < 1e-12 for v, s in found) and len(found) == 10
    assert hits / (10 * len(by)) >= 0.9
    assert [v for v, _ in by[100]] == list(range(101, 111))


def test_few_or_no_vectors(spark):
    rows = [(i, [float(i), 1.0], 0, "c", 0.0) for i in range(0, 400, 100)]
    got = ann.nearest(_vectors(spark, rows)).collect()
    assert Counter(r["query_id"] for r in got) == {0: 3, 100: 3, 200: 3, 300: 3}
    assert ann.nearest(_vectors(spark, rows).limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = db.execute(queries.SQL[name])
    names = [c[0] for c in found.description]
    key = lambda v: f"{v:.12g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(key, r)) for r in df.collect()) == sorted(tuple(key(r[names.index(c)]) for c in df.columns) for r in found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages_do_what_they_say(spark):
    import corpus_pipeline

    from cinderlog.llm import bagminhash, mixing, secrets
    from cinderlog.llm.stages import table

    docs = table(spark, SF, "documents")
    step, columns, seen = docs, docs.columns, []
    for name, f in corpus_pipeline.STAGES:
        out = stage(f(spark, step, SF))
        before, after = step.collect(), out.collect()
        if name != "pack":
            assert out.columns == columns
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
            good = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 1]
            assert len({r["doc_id"] for r in after} & set(good)) >= 0.95 * len(good) and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        if name == "near_dedup":
            classes = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(step).collect()}
            assert {r["doc_id"] for r in after} == set(classes.values())
        if name == "secrets":
            assert len(after) == len(before) and secrets.scan(out).count() == 0
        if name == "mix":
            want = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(step).collect() if r["copies"]}
            assert Counter(r["doc_id"] for r in after) == Counter(want)
        if name == "pack":
            sizes = Counter()
            for r in before:
                sizes[r["doc_id"]] += len((r["text"] or "").encode().split())
            got = Counter()
            for r in after:
                got[r["doc_id"]] += r["piece_size"]
            assert got == sizes
        step = out
        seen.append(name)
    assert seen == ["quality", "near_dedup", "secrets", "mix", "pack"]
    assert corpus_pipeline.run(spark, SF).count() == step.count()


def test_stages_go_where_the_session_says(spark):
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        assert shared_dir(spark) == said.rstrip("/")
    written = stage(spark.range(3))
    assert written._stage_path.startswith(shared_dir(spark)) and written.count() == 3
    drop(written)
    assert not os.path.exists(written._stage_path.removeprefix("file://"))

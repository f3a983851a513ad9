"""Sieving rows before a join: no match is lost, most others go."""

import pytest

from cinderlog.llm import recompress, sieve, stages


def test_sieve_keeps_all_matches(spark):
    table = spark.range(0, 30_000, 3).withColumnRenamed("id", "k")
    rows = spark.range(-100, 60_000).withColumnRenamed("id", "k").union(spark.createDataFrame([(None,)], "k long"))
    kept = {r.k for r in sieve.sieved(rows, table, ["k"]).collect()}
    want = set(range(0, 30_000, 3))
    assert want <= kept and len(kept - want) < 20
    assert rows.count() == sieve.marked(rows, table, ["k"]).count()
    assert {r.k for r in sieve.met(rows, stages.small(stages.stage(table), 0), ["k"]).collect()} == want
    assert sieve.sieved(rows, table.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("most", [0, 500_000])
def test_substrings_agree_whatever_is_broadcast(spark, monkeypatch, most):
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"a{i} b{i} " + (common if i % 3 else " ".join(f"o{i}_{j}" for j in range(30))) + f" z{i}", "en", "s") for i in range(60)]
    rows += [(60 + i, rows[4][1], "en", "s") for i in range(3)] + [(None, common, "en", "s"), (70, None, "en", "s")]
    monkeypatch.setattr(recompress, "MOST_KEYS", most)
    got = {(r.doc_id, r.n_removed) for r in recompress.dedup(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    want = {(i, 40 if i % 3 and i > 1 else 0) for i in range(60)} | {(60 + i, 43) for i in range(3)} | {(None, 0), (70, 0)}
    assert got == want

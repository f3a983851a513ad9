"""The operators over documents, against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cinderlog.llm import bagminhash, fertility, langid, mixing, packing, quality, recompress, secrets


def _words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def _edited(words, edits, seed):
    rng, out = random.Random(seed), list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"e{rng.randrange(10**6)}"
    return out


# mixing


def test_targets_fill_by_weight_under_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5000)], "source string, size long")
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(sizes).collect()}
    # weights 5, 2, 1, 5 (null last): a stops at 30, the rest share 6980 by 2, 1, 5
    assert got["a"] == (10, 30.0) and got["b"][1] == pytest.approx(6980 * 2 / 8) and got["c"][1] == pytest.approx(6980 / 8) and got[None][1] == pytest.approx(6980 * 5 / 8)
    assert sum(t for _, t in got.values()) == pytest.approx(7010)


def test_mix_takes_near_target_and_agrees_with_itself(spark, docs_of):
    docs = docs_of([" ".join(_words(1 + i % 40, i)) for i in range(3000)])
    plan = mixing.mix_plan(docs)
    rows = plan.collect()
    assert len(rows) == 3000 and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) < 0.1 * mine[0]["target"]
    mixed = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert mixed == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]}) and mixing.mix(docs).columns == docs.columns


def test_mix_of_odd_rows(odd):
    rows = mixing.mix_plan(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix_plan(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).count() == 0


# packing


def test_pack_covers_every_word_once(docs_of):
    sizes = [0, 1, 500, 512, 513, 4096, 4097, 20_000, 3, 3]
    rows = packing.pack(docs_of([" ".join(["w"] * n) for n in sizes])).collect()
    for i, n in enumerate(sizes):
        mine = sorted((r["piece"], r["piece_size"]) for r in rows if r["doc_id"] == i)
        assert [p for p, _ in mine] == list(range(len(mine))) and sum(s for _, s in mine) == n
    bins = {}
    for r in rows:
        if r["piece_size"]:
            bins.setdefault((r["bin_id"], r["bin_length"]), []).append((r["bin_offset"], r["piece_size"]))
        else:
            assert r["bin_id"] is None and r["bin_length"] is None
    assert len({b for b, _ in bins}) == len(bins)
    for (_, length), parts in bins.items():
        assert length in packing.LENGTHS and sum(s for _, s in parts) <= length


def test_pack_of_odd_rows(odd):
    assert packing.pack(odd.limit(0)).count() == 0
    rows = packing.pack(odd, shard_docs=2).collect()
    assert len({(r["bin_id"]) for r in rows if r["bin_id"] is not None}) >= 1 and sum(r["piece"] == 0 for r in rows) == odd.count()


# quality rules


def _base(text):
    raw = (text or "").encode()
    words = raw.split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {x for x, n in Counter(windows).items() if n > 1}
    lines = [x for x in raw.split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len({i + k for i, x in enumerate(windows) if x in twice for k in range(5)})


def test_rules_equal_brute_force(docs_of, odd):
    texts = [" ".join(_words(50, i)) + ("\nsame\nsame\n" if i % 3 else "") + "#$" * (i % 4) for i in range(120)] + [" ".join(["ab cd ef"] * 20), "K%%% J### L$$$ " * 10]
    docs = docs_of(texts).union(odd)
    rows = fertility.judge(docs).collect()
    assert len(rows) == docs.count()
    want = Counter(_base(r["text"]) for r in docs.collect())
    assert Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and (not r["kept"] or not r["base_failed"])
    assert fertility.judge(docs.limit(0)).count() == 0


def test_fertility_bands_reject_what_does_not_fit(docs_of):
    good = ["the quick brown fox jumps over the lazy dog and " + " ".join(random.Random(i).choices(["house", "water", "people", "small", "never", "under", "light", "stone", "green", "river", "table", "music"], k=30)) for i in range(200)]
    bad = " ".join(random.Random(0).choices(["\u0f00\u0f01\u0f02", "zq\u0e5b\u0e5axq", "\u1369\u136a"], k=45)) + " a b c"
    rows = {r["doc_id"]: r for r in fertility.judge(docs_of([*good, bad])).collect()}
    assert sum(rows[i]["kept"] for i in range(200)) >= 198
    assert rows[200]["fallback"] > 0.3 and not rows[200]["kept"]


def test_small_groups_are_judged_by_wider_ones(spark, docs_of):
    words = ["house", "water", "people", "small", "never", "under", "light", "stone", "green", "river", "table", "music"]
    good = ["the quick brown fox jumps over the lazy dog and " + " ".join(random.Random(i).choices(words, k=30)) for i in range(60)]
    odd = "\u0f00\u0f01\u0f02\u0e5b\u0e5a\u1369\u136a"
    bad = " ".join("".join(random.Random(i).choices(odd, k=4)) for i in range(40)) + " a b c"
    # a language of one text, a script of one text, and tables too small for any group of MIN_GROUP texts
    for n in (60, 12):
        docs = docs_of([*good[:n], bad, bad, good[0]])
        rare = docs.withColumn("lang", F.when(F.col("doc_id") == n, "xx").when(F.col("doc_id") == n + 2, "yy").when(F.col("doc_id") < n, "en"))
        rows = {r["doc_id"]: r for r in fertility.judge(rare).collect()}
        assert not rows[n]["base_failed"] and not rows[n]["kept"] and not rows[n + 1]["kept"]
        assert sum(rows[i]["kept"] for i in range(n)) >= n - 2 and rows[n + 2]["kept"]


# classifier and languages


@pytest.fixture(scope="module")
def learnable(spark, docs_of):
    good = [" ".join(random.Random(i).choices(["stone", "river", "cloud", "green", "walks", "under"], k=40)) for i in range(300)]
    bad = [" ".join(["BUY!!", "NOW%%%", "spam"][random.Random(i).randrange(3)] for _ in range(1) for _ in range(40)) for i in range(100)]
    docs = docs_of(good + bad)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400) if i % 2] + [(1, 1, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_classifier_learns(learnable, odd):
    docs, labels = learnable
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 400 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert sum((r["doc_id"] < 300) == bool(r["predicted"]) for r in rows) > 390
    odd_rows = quality.classify(odd, labels.limit(0)).collect()
    assert len(odd_rows) == odd.count() and {r["score"] for r in odd_rows} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_languages(spark, docs_of, odd):
    two = [" ".join(random.Random(i).choices(["the", "and", "with", "house"] if i % 2 else ["\u00fcber", "nicht", "schon", "wei\u00df"], k=25)) for i in range(200)]
    docs = docs_of(two).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").when(F.col("doc_id") != 4, "de"))
    rows = langid.identify(docs).collect()
    assert len(rows) == 200 and all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") and 0 <= r["score"] <= 1 for r in rows)
    found = {r["doc_id"]: r for r in langid.identify(odd).collect() if r["doc_id"] is not None}
    assert (found[0]["lang_pred"], found[0]["score"]) == ("und", 0.0) and found[3]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(odd.limit(0)).count() == 0


# substrings


def _dedup(rows):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, ws in split:
        for k in range(len(ws) - 12):
            if i is not None:
                w = tuple(ws[k : k + 13])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in split:
        gone = set()
        for k in range(len(ws) - 12):
            if i is not None and first[tuple(ws[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out.append((i, len(ws), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(ws) if k not in gone)).hexdigest()))
    return Counter(out)


def test_substrings_equal_brute_force(docs_of, odd):
    passage, texts = _words(60, 1), []
    for i in range(80):
        own = _words(40, 100 + i, 30)
        kind = i % 6
        texts.append(" ".join(own + passage[i % 30 : i % 30 + 10 + i % 25] + own[:5] if kind < 3 else own[:14] * 3 if kind == 3 else _words(40, 7) if kind == 4 else ["z"] * (10 + i)))
    docs = docs_of(texts + texts[:4]).union(odd)
    got = recompress.dedup(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got) == _dedup(rows)
    assert recompress.dedup(docs.limit(0)).count() == 0


# near duplicates


def _classes(rows, similar=0.8):
    sets = {}
    for i, t in rows:
        ws = (t or "").encode().split()
        sets[i] = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)) or Counter([tuple(ws)] if ws else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = sum((sets[a] & sets[b]).values())
            if shared >= similar * (sets[a].total() + sets[b].total() - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_classes_equal_brute_force(docs_of):
    rows, base = [], _words(140, 5, 10_000)
    for i in range(90):
        # copies with so many changes that many are far from the pivot and some only close to each other
        rows.append((1000 + i, " ".join(_edited(base, 1 + i % 6, i))))
    for i in range(6):
        far = _edited(base, 9, 500)
        rows.append((2000 + i, " ".join(_edited(far, 1 + i % 2, 600 + i))))
    rows += [(3000 + i, " ".join(_words(60, 700 + i, 50))) for i in range(30)]
    rows += [(4000 + i, t) for i, t in enumerate(["a b", "a b", "a c", None, "", "a b c d e", "a b c d e", " ".join(["q"] * 300), " ".join(["q"] * 290), " ".join(["q"] * 200)])]
    random.Random(2).shuffle(rows)
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs_of(rows)).collect()}
    assert got == _classes(rows)


@pytest.mark.parametrize("cut_id", [999, 2000])
def test_copies_of_an_absent_text_are_linked(docs_of, cut_id):
    # copies have own words at their end, so that they share no difference from the text that most of them hold, and
    # the copy nearest to it is too short to be linked to any
    base = _words(184, 8, 10_000)
    rows = [(1000 + i, " ".join(base + [f"own{i}x{k}" for k in range(21)])) for i in range(24)] + [(cut_id, " ".join(base[:-20]))]
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs_of(rows)).collect()}
    assert got == _classes(rows) and set(got.values()) == {1000, cut_id}


def test_many_texts_that_meet_at_an_element_are_a_group_again(docs_of, monkeypatch):
    # families share changes, so that many of one meet at an element; most are far from the middle
    base, rows = _words(140, 5, 10_000), []
    for i in range(96):
        rows.append((1000 + i, " ".join(_edited(_edited(base, 2, 300 + i % 6), 1 + i % 5, i))))
    sizes, paired = [], bagminhash.paired

    def seen(met, similar):
        sizes.extend(r["n"] for r in met.where("answers").groupBy("a", "h").agg(F.count("*").alias("n")).collect())
        return paired(met, similar)

    monkeypatch.setattr(bagminhash, "paired", seen)
    monkeypatch.setattr(bagminhash, "FEW", 3)
    monkeypatch.setattr(bagminhash, "CROWD", 4)
    rounds, again = [], bagminhash.meetings
    monkeypatch.setattr(bagminhash, "meetings", lambda *x: rounds.append(1) or again(*x))
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs_of(rows)).collect()}
    assert got == _classes(rows) and len(rounds) > 1 and max(sizes, default=0) <= 3


def test_near_duplicates_of_odd_rows(odd):
    rows = bagminhash.near_duplicates(odd).collect()
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    assert classes[3] == classes[4] == 3 and classes[9] == classes[10] == 9 and classes[0] == 0
    kept = bagminhash.first_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IS NULL").count() == 2 and kept.where("doc_id IN (4, 10)").count() == 0
    assert bagminhash.near_duplicates(odd.limit(0)).count() == 0


def test_rows_of_null_id_are_classes_of_null(odd):
    rows = bagminhash.near_duplicates(odd).where("doc_id IS NULL").collect()
    assert [(r["class_id"], r["copy_of"]) for r in rows] == [(None, None)] * 2


# secrets


def _tree(tree, x, names):
    while isinstance(tree, tuple):
        tree = tree[2] if x[names[tree[0]]] <= tree[1] else tree[3]
    return tree


def test_secrets_found_and_look_alikes_left(spark, docs_of):
    hexes = hashlib.sha1(b"x").hexdigest()
    texts = [
        f'some words token = "{hexes}" more words', f"fixed in commit {hexes} today", "see https://example.org/posts/a-long-slug-with-2024-words and go", "password: hunter2aA9xKq81Zmw0PQ",
        "id 123e4567-e89b-12d3-a456-426614174000 ok", None, "", "nothing", f'A token%%% =&&& "{hexes}"### B',
    ]
    docs = docs_of(texts)
    found = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert set(found) == {0, 3, 8}
    for i, r in found.items():
        assert texts[i][r["start"] - 1 :].startswith(r["secret"]) and r["score"] >= 0.5
    clean = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert clean[0]["text"] == 'some words token = "[SECRET]" more words' and clean[0]["n_chars"] == len(clean[0]["text"])
    assert all(clean[i]["text"] == texts[i] for i in (1, 2, 4, 5, 6, 7)) and secrets.redact(docs).columns == docs.columns


def test_unquoted_values_after_names_are_found(docs_of):
    value = "hunter2aA9xKq81Zmw0PQ7dTe4Rb"
    texts = [f"API_KEY={value}", f"run with token={value} set", f"GET http://h.example/x?access_token={value}&page=2", f"AWS_S3_SECRET_ACCESS_KEY={value}\nDEBUG=1", f"password={value}=="]
    found = {r["doc_id"]: r["secret"] for r in secrets.scan(docs_of(texts)).collect()}
    assert found == dict.fromkeys(range(4), value) | {4: value + "=="}
    assert secrets.redact(docs_of(texts[:1])).first()["text"] == "API_KEY=[SECRET]"


def test_forest_in_sql_equals_its_trees(spark):
    trees, names = secrets.forest(spark), list(secrets.FEATURES)
    rows = spark.createDataFrame(secrets.labelled_findings(seed=99), "b string, t string, a string, p string, y int")
    got = secrets.found_in(rows).where("x IS NOT NULL").select("x", "y", "cand", F.expr(f"transform(array(x), x -> {secrets.mean_sql(trees)})[0]").alias("score")).collect()
    right = 0
    for r in got:
        assert r["score"] == pytest.approx(sum(_tree(t, r["x"], names) for t in trees) / len(trees))
        c, x = r["cand"], r["x"]
        share = lambda keep, c=c: sum(map(keep, c)) / len(c)
        assert x["len"] == len(c) and x["digits"] == pytest.approx(share(lambda k: k in "0123456789")) and x["upper"] == pytest.approx(share(lambda k: "A" <= k <= "Z"))
        assert x["marks"] == pytest.approx(share(lambda k: not k.isalnum())) and x["kinds"] == pytest.approx(len(set(c)) / min(len(c), 40)) and x["slashes"] == pytest.approx(c.count("/") / len(c)) and x["dots"] == pytest.approx(c.count(".") / len(c))
        right += (r["score"] >= 0.5) == bool(r["y"])
    assert right / len(got) > 0.95


def test_scan_of_odd_rows(odd):
    assert secrets.scan(odd).count() == 0 and secrets.scan(odd.limit(0)).count() == 0 and secrets.redact(odd).count() == odd.count()

"""The array code without Spark, against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cinderlog.llm import ann, bagminhash, fertility, langid, packing, quality, recompress
from cinderlog.llm.words import pieces, scan, utf8, window_names

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x1c\u00a0!", max_size=40)), max_size=8)


def _scan(texts):
    return scan(*utf8(pa.array(texts, pa.string())))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_bytes_split(texts):
    w = _scan(texts)
    raw = w.data.tobytes()
    got = [[raw[a:b] for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [(t or "").encode().split() for t in texts]
    names = {}
    for word, name in zip([x for ws in got for x in ws], w.name.tolist(), strict=True):
        assert names.setdefault(word, name) == name
    assert len(set(names.values())) == len(names)


def test_pieces_keep_rows_and_bound_bytes():
    texts = ["x" * n for n in (10, 3_000_000, 0, 5)] + [None] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["i", "text"])
    got = list(pieces(iter([batch])))
    assert [i for b in got for i in b.column("i").to_pylist()] == list(range(7)) and len(got) >= 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.integers(1, 4))
def test_equal_windows_have_equal_keys(docs, rounds):
    w = _scan([" ".join("abc"[x] for x in d) for d in docs])
    s = recompress.symbols_of(w, lowest=rounds)
    seen = {}
    for a, key in zip(s.at.tolist(), s.key.tolist(), strict=True):
        window = tuple(w.name[a : a + recompress.WIDTH].tolist())
        assert seen.setdefault(window, key) == key
    want = sum(max(0, len(d) - recompress.WIDTH + 1) for d in docs)
    assert len(s.at) == want and (np.diff(s.owner) >= 0).all()


def _passages(rng, words, passage):
    return [words(rng) + passage + words(rng) for _ in range(6)]


def test_symbols_of_all_rounds_recur_with_their_words():
    # inside equal words stand equal symbols of equal ranges, whatever is around
    rng = random.Random(4)
    passage = [f"p{rng.randrange(40)}" for _ in range(300)]
    texts = _passages(rng, lambda r: [f"w{r.randrange(40)}" for _ in range(r.randrange(5, 90))], passage)
    w = _scan([" ".join(t) for t in texts])
    s = recompress.symbols_of(w)
    ranges = {tuple(w.name[a:b].tolist()) for a, b in zip(s.low.tolist(), s.high.tolist(), strict=True)}
    names = set(zip(s.name.tolist(), s.check.tolist(), strict=True))
    assert len(ranges) == len(names) and all(len(r) >= recompress.WIDTH for r in ranges)
    found = []
    for i in range(6):
        at = w.first[i] + len(texts[i]) - len(texts[i][texts[i].index(passage[0]) :])
        start = next(k for k in range(len(texts[i])) if texts[i][k : k + 300] == passage) + w.first[i]
        mine = (s.low >= start) & (s.high <= start + 300)
        found.append([(a - start, b - start, n) for a, b, n in zip(s.low[mine].tolist(), s.high[mine].tolist(), s.name[mine].tolist(), strict=True)])
        assert at <= start
    assert all(f == found[0] for f in found) and len(found[0]) > 10
    covered = {k for a, b, _ in found[0] for k in range(a, b)}
    assert len(covered) > 200


@settings(max_examples=100, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 30), st.integers(1, 13)), max_size=30), st.integers(13, 45))
def test_least_in_windows(pairs, n):
    pairs = sorted((a, s) for a, s in pairs if a + s <= n)
    low, size = (np.asarray([p[k] for p in pairs], np.int64) for k in (0, 1))
    value = np.random.default_rng(len(pairs)).integers(0, 2**63, len(pairs)).astype(np.uint64)
    got = recompress.least_in_windows(n, low, low + size, value, 13)
    for a in range(n - 12):
        inside = value[(low >= a) & (low + size <= a + 13)]
        assert got[a] == (inside.min() if len(inside) else recompress._NONE)


def test_window_keys_are_fewer_than_windows():
    rng = random.Random(1)
    w = _scan([" ".join(f"w{rng.randrange(500)}" for _ in range(5000))])
    s = recompress.symbols_of(w)
    assert len(recompress._changes(s.owner, s.key)[1]) < 0.4 * len(s.at)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), max_size=4))
def test_repeated_words(docs):
    w = _scan([" ".join("abcd"[x] for x in d) for d in docs])
    for d, got in zip(docs, fertility.repeated_words(w.name, w.first), strict=True):
        windows = [tuple(d[i : i + 5]) for i in range(len(d) - 4)]
        twice = {x for x, n in Counter(windows).items() if n > 1}
        assert got == len({i + k for i, x in enumerate(windows) if x in twice for k in range(5)})


def test_repeated_lines():
    assert fertility.repeated_lines(b"a\n\na\n \nb\na\n") == 2


def test_window_names_tell_windows_apart():
    names = np.arange(1, 1001, dtype=np.uint64)
    assert len(set(window_names(names, 13, 1).tolist())) == 988 and len(window_names(names[:5], 13, 1)) == 0


def test_signatures_are_unbiased_for_weighted_jaccard():
    rng = np.random.default_rng(3)
    names = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a = rng.integers(0, 9, 300)
    b = np.where(rng.random(300) < 0.6, a, rng.integers(0, 30, 300))
    n, o, c = np.concatenate([names[a > 0], names[b > 0]]), np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]), np.concatenate([a[a > 0], b[b > 0]])
    s = bagminhash.signatures(n, o, c, 3, 8192)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 4 * (want * (1 - want) / 8192) ** 0.5 and np.isinf(s[2]).all()


def test_large_weights_take_few_points():
    s = bagminhash.signatures(np.asarray([7, 7], np.uint64), np.asarray([0, 1]), np.asarray([1_000_000, 900_000]), 2)
    assert np.isfinite(s).all() and 0.7 < (s[0] == s[1]).mean() <= 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4096), max_size=200))
def test_best_fit_places_every_piece_once(sizes):
    bins, offsets, lengths = packing.best_fit(sizes)
    held = Counter()
    spans = {}
    for size, b, at in zip(sizes, bins.tolist(), offsets.tolist(), strict=True):
        held[b] += size
        spans.setdefault(b, []).append((at, at + size))
    for b, parts in spans.items():
        parts.sort()
        assert parts[0][0] == 0 and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
        assert held[b] <= lengths[b] and not any(held[b] <= c < lengths[b] for c in packing.LENGTHS)
    assert len(lengths) == len(spans)


def test_best_fit_wastes_little():
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(6, 1, 5000).astype(int) + 1, 4096)
    _, _, lengths = packing.best_fit(sizes)
    assert sizes.sum() / lengths.sum() > 0.97


def test_profiles_separate_alphabet_statistics():
    data, bounds = utf8(pa.array(["the cat sat on the mat", "the mat sat on the cat", "xyz qqq zzx qyx", "", None, "12 !"]))
    found, lettered = langid.profiles(data, bounds)
    unit = langid._unit(found)
    assert unit[0] @ unit[1] > 0.6 > unit[0] @ unit[2] and lettered.tolist() == [True, True, True, False, False, False]
    assert not found[3].any()


def _profile(text, dim):
    """The bundle, letter by letter."""
    points = [int(langid.folded(np.asarray([ord(c)]))[0]) for c in text]
    marked = [0, *points, 0]
    marked = [c for i, c in enumerate(marked) if i == 0 or c or marked[i - 1]]
    out = np.zeros(dim)
    for i in range(len(marked) - 2):
        if marked[i + 1]:
            a, b, c = langid.letter_vectors(np.asarray(marked[i : i + 3]), dim).astype(int)
            out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_profiles_equal_letter_by_letter_in_all_scripts():
    texts = ["The quick  brown", "\u0447\u0435\u043b\u043e\u0432\u0435\u043a \u0438", "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0 \U000323b0\U00020000", "\u0928\u092e\u0938\u094d\u0924\u0947 \u0e20\u0e32\u0e29\u0e32", "", "a1b"]
    for rows in (texts, texts[::-1], texts[2:3]):
        found, lettered = langid.profiles(*utf8(pa.array(rows)), 64)
        assert lettered.tolist() == [bool(t) for t in rows]
        for t, row in zip(rows, found, strict=True):
            assert np.array_equal(row, _profile(t, 64))


def test_profiles_of_many_letters_go_in_blocks():
    rng = random.Random(3)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20_000))
    found, _ = langid.profiles(*utf8(pa.array([text])), 16)
    assert np.array_equal(found[0], _profile(text, 16))


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, quality.POOLED))
    x[:, 3:] = 0
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.Model(np.zeros((1, 1))).fit(x[:3000], y[:3000])
    p = model.scores(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.85 and abs(p.mean() - y[3000:].mean()) < 0.06
    assert quality.Model(np.zeros((1, 1))).fit(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]


def test_codebook_lowers_parallel_error():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    along = {}
    for eta in (1.0, 8.0):
        book = ann.Codebook(16)
        book.eta = eta
        codes = book.fit(x).encode(x)
        back = np.concatenate([book.centroids[p][codes[:, p]] for p in range(book.parts)], axis=1)
        r = x - back
        along[eta] = ((r * u).sum(axis=1) ** 2).mean()
        assert (r * r).sum(axis=1).mean() < 0.6 * (x * x).sum(axis=1).mean()
    assert along[8.0] < 0.5 * along[1.0]
    packed = codes[:, 0::2] * 16 + codes[:, 1::2]
    tables = book.tables(x[:3])
    scans = sum(tables[:, p, :][:, packed[:, p]] for p in range(packed.shape[1]))
    assert np.allclose(scans, x[:3] @ back.T, atol=1e-3)


def test_chosen_prefers_first_of_equals():
    scores = np.asarray([[1.0, 5, 5, 5, 5, 9]])
    assert sorted(ann.chosen(scores, 3)[0].tolist()) == [1, 2, 5]


def test_long_repeats_are_settled_by_high_symbols():
    rng = random.Random(9)
    passage = [f"p{rng.randrange(300)}" for _ in range(200)]
    texts = [" ".join([f"x{i}y{k}" for k in range(40)] + passage + [f"z{i}y{k}" for k in range(40)]) for i in range(2)]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([0, 0], pa.int32()), pa.array(texts)], ["doc_id", "nth", "text"])
    (keys,) = recompress.reveal(iter([batch]))
    rows = {}
    for c in ("highs", "lows"):
        a, b = (set(x) for x in keys.column(c).to_pylist())
        rows[c] = a & b
    asked = {}
    for name, highs in (("all", rows["highs"]), ("none", set())):
        lists = [pa.array([[], list(x)], pa.list_(pa.int64())) for x in (highs, rows["lows"])]
        (out,) = recompress.candidates(iter([pa.RecordBatch.from_arrays([*batch.columns, *lists], ["doc_id", "nth", "text", "highs", "lows"])]))
        asked[name] = out.to_pylist()
    ranges = [r for r in asked["all"] if r["h1"] is None]
    windows = {name: [r["place"] for r in found if r["h1"] is not None] for name, found in asked.items()}
    # one range stands for most of the passage, and only its ends are looked up window by window
    assert len(ranges) == 1 and 130 < ranges[0]["size"] <= 200 and 40 <= ranges[0]["place"]
    assert len(windows["none"]) >= 188 and len(windows["all"]) < 0.4 * len(windows["none"])
    inside = set(range(ranges[0]["place"], ranges[0]["place"] + ranges[0]["size"] - 12))
    assert not inside & set(windows["all"])


def test_pooled_equals_word_by_word():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    texts = ["one two two three one one", "", "A" * 90 + " b!! b!!", "x"]
    got = quality.pooled(_scan(texts), vectors)
    for t, row in zip(texts, got, strict=True):
        words = [vectors[list(quality.word_features(x))].sum(axis=0) for x in t.encode().split()]
        if not words:
            assert not row.any()
            continue
        x, raw = np.asarray(words), t.split()
        n = len(raw)
        alike = [sum(raw[i] == raw[i - k] for i in range(k, n)) / n for k in (1, 2)] + [sum(float(x[i] @ x[i - 1]) for i in range(1, n)) / n]
        assert np.allclose(row, [*x.mean(axis=0), *np.sqrt(np.maximum((x * x).mean(axis=0) - x.mean(axis=0) ** 2, 0)), *alike, np.log1p(n)], atol=2e-2, rtol=1e-3)


def test_long_words_differ_by_their_ends():
    assert quality.word_features(b"a" * 70 + b"b") != quality.word_features(b"a" * 70 + b"c")
    encoder = fertility.Encoder(fertility.TOKENIZERS)
    word = ("Donaudampfschifffahrt" * 40).encode()
    ids, counts, n = encoder.words([1], [word])
    assert ids.tolist() == encoder.piece.encode(word.decode()) and counts.tolist() == [len(ids)] and n.tolist() == [len(encoder.byte.encode_ordinary(" " + word.decode()))]


def test_conjugate_gradients_solve():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(20, 20))
    a = a @ a.T + 20 * np.eye(20)
    b = rng.normal(size=20)
    assert np.allclose(a @ ann._solved(lambda v: a @ v, b, np.zeros(20), np.diag(a).copy()), b, atol=1e-6)

"""Rows on which a shortened job gives other results than the whole one."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_operators import by_id, frame, prose
from tidemark.llm import contamination, jaccard, quality


def test_ngram_join_links_inside_a_group(spark, monkeypatch):
    # With one level for all slots, shingles are in the order of their hashes, so texts of one prefix may differ in rare words.
    monkeypatch.setattr(jaccard, "_order_sketch", lambda docs, size: np.zeros(1 << jaccard.SKETCH_BITS, np.uint8))
    rows = []
    for k in range(60):
        w = [f"{k}w{i}" for i in range(22)]
        ends = [["x", "y", "z"], w[19:], [*w[19:21], "last"]]
        rows += [(10 * k + i, " ".join([*w[:19], *end])) for i, end in enumerate(ends)]
    want = sorted(brute.jaccard_components(rows))
    assert {c % 10 for _, _, c in want} == {0, 1}
    sets = jaccard.shingle_sets(frame(spark, rows).select("doc_id", "text"), 3, 90).collect()
    assert any(len({r["head"] for r in sets if r["doc_id"] // 10 == k}) == 1 for k in range(60))
    assert by_id(jaccard.near_duplicates(frame(spark, rows), 3, 90), "doc_id", "n_shingles", "component_id") == want


def test_leaks_of_long_items(spark):
    items = [(n, prose(2000 + n, n) + ".") for n in (65, 100, 130, 172, 200, 257, 400, 1000)]
    words = {i: t.rstrip(".").split() for i, t in items}
    rows, want = [], []
    for i, w in words.items():
        changed = [x if k % 5 else f"other{k}" for k, x in enumerate(w)]
        for k, (before, own, leak) in enumerate(((0, w, True), (77, w, True), (40, changed, True), (30, w[:int(0.4 * i)], False))):
            rows.append((10 * i + k, " ".join([prose(3000 + i + k, before), *own, prose(4000 + i + k, 50)])))
            want += [(10 * i + k, i)] * leak
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, rows + [(100_000 + i, prose(5000 + i, 300)) for i in range(60)])
    got = contamination.find_leaks(df, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted(want)
    assert all(r["lcs_share"] == 1 for r in got if r["doc_id"] % 10 < 2)


def test_quality_reads_whole_chunks():
    def features_of(text):
        out, _, share = quality.features([text.encode()])
        return sorted(out.tolist()), float(share.sum())

    for start in ("字" * 70, "a" * 250, "aé" * 100, "-a" * 6, "x" + "😀" * 60):
        assert features_of(start + "甲") != features_of(start + "乙"), start
        assert features_of(start + "甲" * 400 + "丙") != features_of(start + "甲" * 400 + "丁"), start
        assert abs(features_of(start * 30)[1] - 4) < 1e-9               # a vector's parts still sum to four
    word = "字x" * 500
    assert b"".join(quality._cut(word.encode())) == word.encode() and all(len(p) <= quality.WORD and p.decode() for p in quality._cut(word.encode()))
    # Labels that hang on the ends of long chunks alone are learned.
    texts = [("字" * 100 + f"{i % 7}" + ("好" * 80 if i % 2 else "坏" * 80)).encode() for i in range(200)]
    y = np.array([i % 2 for i in range(200)], float)
    w, bias = quality.ftrl(texts, y)
    assert ((quality._scores(*quality.features(texts), len(texts), w, bias) >= 0.5) == (y == 1)).all()


def test_pairs_across_components_leave_out_those_inside(spark):
    rows = [(1, i, 20, 0, 0, 0) for i in range(50)] + [(1, 99, 20, 0, 99, 0), (2, 3, 20, 0, 0, 0), (2, 99, 20, 0, 99, 0), (2, 98, 20, 0, 98, 0)]
    rest = spark.createDataFrame(rows, "shingle long, cls long, n int, place int, comp long, largest long")
    assert jaccard._outside(rest).count() == 3
    assert sorted(map(tuple, jaccard._across(rest, 90).collect())) == sorted([*((i, 99) for i in range(50)), (3, 98), (98, 99)])


def test_parity_bits_lose_no_linked_pair(spark):
    rows = []
    for k in range(40):
        w = prose(7000 + k, 30 + 13 * k).split()
        for c in range(4):                                      # copies with ever more words replaced, from exact to far
            rows.append((10 * k + c, " ".join(x if (i * 7919 + c) % 1000 >= 10 * c else f"new{c}" for i, x in enumerate(w))))
    rows += [(1, rows[5][1]), (2, None), (3, "one")]            # an id with two texts
    df = frame(spark, rows).select("doc_id", "text")
    for size, percent in ((3, 90), (5, 80), (3, 50)):
        sets = jaccard.shingle_sets(df, size, percent).persist()
        ids = sorted({d for d, _ in rows})
        pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "a long, b long")
        close = {tuple(r) for r in jaccard.close_pairs(pairs, sets, percent).collect()}
        parts = {d: [] for d in ids}
        for d, t in rows:
            w = (t or "").split()
            parts[d].append(set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else {tuple(w)} if w else set())
        linked = {(a, b) for a in ids for b in ids if a < b and any(
            x and y and 100 * len(x & y) >= percent * len(x | y) for x in parts[a] for y in parts[b])}
        assert linked <= close and len(linked) > 20
        assert percent < 80 or len(close) < len(ids) * (len(ids) - 1) / 8       # and most others are left out


def test_salted_and_growing_steps_lose_no_link(spark, monkeypatch):
    rows = []
    for k in range(6):                                          # texts that share a passage; near and far copies of each
        w = (prose(9000 + k, 40) + " " + prose(8999, 30)).split()
        rows += [(10 * k + c, " ".join(x if i < 3 * c or i >= 4 * c else f"new{c}" for i, x in enumerate(w))) for c in range(6)]
    want = sorted(brute.jaccard_components(rows))
    monkeypatch.setattr(jaccard, "PAIRS_OF_A_TASK", 1)          # every shingle is dealt over salts
    assert by_id(jaccard.near_duplicates(frame(spark, rows), 3, 90), "doc_id", "n_shingles", "component_id") == want
    monkeypatch.setattr(jaccard, "AT_ONCE", 0)                  # steps of 1, 2, 4, ... classes only
    monkeypatch.setattr(jaccard, "MANY", 1)
    monkeypatch.setattr(jaccard, "GROWTH", 2)
    assert by_id(jaccard.near_duplicates(frame(spark, rows), 3, 90), "doc_id", "n_shingles", "component_id") == want


def test_folded_bits_stay_a_bound():
    rng = np.random.default_rng(5)
    for n in (1, 100, 128, 129, 700, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[len(x) // 10:], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)]))
        away = len(np.setxor1d(x, y))
        bits = jaccard.parity(x), jaccard.parity(y)
        assert jaccard.apart(*bits) <= away and jaccard.apart(bits[0], bits[0]) == 0
        assert int(np.bitwise_count(jaccard.folded(bits[0]) ^ jaccard.folded(bits[1])).sum()) <= jaccard.apart(*bits)


def test_pairs_across_components_meet_where_their_shared_shingles_begin(spark):
    # Three classes share 30 shingles, but for one of class 2 in the middle: its pairs are made twice instead of 29 times.
    rows = [(s, c, 400, s, c) for s in range(30) for c in (1, 2, 3) if (s, c) != (15, 2)]
    rest = jaccard.with_largest(spark.createDataFrame(rows, "shingle long, cls long, n int, place int, comp long"))
    assert {r["across"] for r in rest.collect()} == {3.0, 1.0}
    before = {(r["cls"], r["shingle"]): r["before"] for r in jaccard.with_previous(rest).collect()}
    assert before[1, 0] is None and before[1, 16] == 15 and before[2, 16] == 14
    made = jaccard._joined(jaccard.with_previous(rest), ["shingle"], [], 90)
    assert sorted(map(tuple, made.collect())) == [(1, 2), (1, 2), (1, 3), (2, 3), (2, 3)]
    assert sorted(map(tuple, jaccard._across(rest, 90).collect())) == [(1, 2), (1, 3), (2, 3)]
    assert sorted(map(tuple, jaccard._across(rest, 90, F.lit(2e6)).collect())) == [(1, 2), (1, 3), (2, 3)]      # dealt over salts

"""Byte-pair coding, fill-in-the-middle and hard negatives against the library, a plain version and a full search."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import ROWS, TWICE, frame, given  # noqa: F401
from tidemark.llm import bpe, fim, negatives
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [*TWICE, (30, "a" * 30_000 + "é" * 3_000), (31, "x\n\n\r\n é\n<P>"), (32, "no end é字😀\nlast"), (33, "\n"), (34, "\n\n\n"),
       (35, "it's we'll  '     \x1c\x85 1٣½ 字字 <|endoftext|><|endoftext|> <|endof"), (36, "<" + "S" * 40 + ">\nP>\n<"), (37, "é"), (38, "ab")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(BYTES, bpe.character_classes(BYTES))


def test_encoding_equals_the_library(spark, library):
    got = bpe.encode_texts(frame(spark, ODD), BYTES, decoded=True).collect()
    want = Counter()
    for d, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want


def test_ids_decode_to_texts(spark, library):
    ids = [[], None, [50256, 0, 255], [50257, 5, None, -1], list(range(0, 50257, 7))]
    df = spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>").withColumn("text", F.lit("other"))
    known = [None if i is None else [x for x in i if x is not None and 0 <= x < 50257] for i in ids]
    want = [None if i is None else library.decode(i, skip_special_tokens=False) for i in known]
    assert [r["text"] for r in bpe.decode_ids(df, BYTES).orderBy("doc_id").collect()] == want
    coded = bpe.encode_texts(frame(spark, ODD), BYTES)
    back = bpe.decode_ids(coded, BYTES).collect()
    assert Counter(map(tuple, back)) == Counter((d, t or "") for d, t in ODD)


def test_random_texts(library, own):
    r = random.Random(5)
    signs = [*"abcdeTHE thein   \n\t'sdmltre0129.,!-", "é", "ß", "字", "😀", "́", "​", "\xa0", "\x85", "\x1c", "'ll", "<|endoftext|>", "\U0001e900", "　"]
    for _ in range(3_000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 40)))
        ids = np.frombuffer(own.encode(text.encode()), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_pattern_knows_the_classes_of_the_library(library, own):
    cut = library.pre_tokenizer.pre_tokenize_str
    for c in [*range(0, 0x3100), *range(0xA7C0, 0xAC10), *range(0x10930, 0x10980), *range(0x3FC2C, 0x3FC40), *range(0xE000, 0x110000, 997)]:
        text = f"a{chr(c)}1{chr(c)}-{chr(c)}x {chr(c)}{chr(c)}"
        assert own.cut(text) == [text[a:b] for _, (a, b) in cut(text)], hex(c)


def test_merges_equal_the_plain_rule(own):
    def plain(symbols):
        while True:
            ranked = [(own.merges[a << 32 | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a << 32 | b in own.merges]
            if not ranked:
                return symbols
            (_, new), i = min(ranked)
            symbols = [*symbols[:i], new, *symbols[i + 2:]]
    r = random.Random(3)
    for _ in range(2_000):
        start = [own.first[r.choice(b"ab cethinE\xc3\xa9aa")] for _ in range(r.randint(0, 25))]
        assert own.merge(list(start)) == plain(start)


def test_a_full_memory_and_unknown_files(own, monkeypatch, tmp_path):
    monkeypatch.setattr(bpe, "KEPT", 2)
    small = bpe.Codec(BYTES, bpe.character_classes(BYTES))
    text = "some words that fill it again and again".encode()
    assert small.encode(text) == own.encode(text) and len(small) <= 2
    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("word_bpe_49k.json"), {})


def filled(doc, text, unit="line", percent=100, percent_spm=50, seed=7):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in fim.MARKS) or h[2] % 100 >= percent:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < percent_spm:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("how", [{}, {"unit": "char"}, {"unit": "char", "percent": 50, "percent_spm": 0, "seed": 11}, {"percent": 70, "percent_spm": 100}])
def test_fill_in_middle(spark, given, how):  # noqa: F811
    for rows in (ODD, given):
        got = fim.fill_in_middle(frame(spark, rows), **how).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert Counter(tuple(r)[:6] for r in got) == Counter(filled(d, t, **how) for d, t in rows)
        assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((d, t or "") for d, t in rows)


def test_cuts_between_code_points_and_bytes():
    r = random.Random(2)
    for _ in range(500):
        text = "".join(r.choice("ab\né字😀") for _ in range(r.randint(0, 30)))
        raw = text.encode()
        index = fim.ExceptionIndex(np.frombuffer(raw, np.uint8))
        at = np.arange(len(text) + 1)
        places = np.array([len(text[:k].encode()) for k in at])
        assert index.to_bytes(at).tolist() == places.tolist() and index.to_chars(places).tolist() == at.tolist()
    with pytest.raises(ValueError):
        fim.fill_in_middle(None, unit="word")


def test_broken_bytes_are_replaced(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61C3280A62FF' AS STRING) AS text")
    row = fim.fill_in_middle(df).first()
    assert row["output"] == filled(1, b"a\xc3(\nb\xff".decode("utf-8", "replace"))[5]
    assert bpe.encode_texts(df, BYTES, decoded=True).first()["decoded"] == "a�(\nb�"


def searched(rows, positives=5, most=10, low=30, high=90, scale=256, anchor=lambda i: i % 3 == 0):
    """(anchor, positive_rank, positive, rank, negative, both scores) by looking at every pair; rows have distinct ids."""
    fine = sorted({(i, lab, tuple(math.floor(scale * x) for x in v)) for i, v, lab in rows
                   if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, lab, v in fine:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in fine if j != i)
        for p, (ps, pid, _) in enumerate([s for s in scored if s[2] == lab][:positives]):
            inside = [s for s in scored if s[2] != lab and low * -ps <= 100 * -s[0] <= high * -ps]
            out += [(i, p + 1, pid, k + 1, nid, -ps, -ns) for k, (ns, nid, _) in enumerate(inside[:most])]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("key", "id", "vec", "v", "shard", "share", "side", "windows", "score", "rank")]).repartition(3)
    found = negatives.mine(df, F.col("id") % 3 == 0, **how)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_rank", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(n, d, labels, seed, spread=1.0, groups=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, d))
    x = centres[r.integers(0, groups, n)] + spread * r.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(x, r.integers(0, labels, n)))]


@pytest.mark.parametrize("how", [{}, {"shard_rows": 40, "codes": 4}, {"codes": 1}, {"positives": 2, "negatives": 3, "least_percent": -50, "most_percent": 100}])
def test_negatives_equal_a_full_search(spark, how):
    rows = vectors(240, 8, 4, 1, 0.3) + [(1000 + i, v, lab) for i, v, lab in vectors(60, 8, 4, 2, 1.0)]
    named = {"positives": "positives", "negatives": "most", "least_percent": "low", "most_percent": "high"}
    assert mined(spark, rows, **how) == searched(rows, **{named[k]: v for k, v in how.items() if k in named})


def test_awkward_vectors(spark):
    same = [0.5, -0.25, 0.125]
    nan, inf = float("nan"), float("inf")
    rows = [(i, same, i % 3) for i in range(60)]                                   # one very common vector
    rows += [(100 + i, [0.5, -0.2 - i / 100, 0.1], i % 3) for i in range(30)] + rows[:5] + rows[60:63]          # rows that repeat
    rows += [(200, None, 1), (201, same, None), (None, same, 1), (202, [nan, 0.0, 0.0], 1), (203, [inf, 0.0, 0.0], 1), (204, [None, 0.1, 0.2], 1),
             (205, [], 1), (206, [0.5], 2), (207, [0.0, 0.0, 0.0], 0), (210, [-0.5, 0.25, -0.125], 9), (213, [1.0, 1.0], 77)]
    padded = [(i, None if v is None else [*v, *[0.0] * (3 - len(v))], lab) for i, v, lab in rows]
    assert mined(spark, rows) == searched(padded)
    assert mined(spark, rows, shard_rows=7) == searched(padded)


@pytest.mark.parametrize("factor", [1e3, 1e6, 1e9])
def test_large_components_stay_exact(spark, factor):
    rows = [(i, [x * factor for x in v], lab) for i, v, lab in vectors(60, 4, 3, 7, 0.4)]
    if factor < 1e9:
        assert mined(spark, rows, least_percent=10) == searched(rows, low=10)
    else:
        with pytest.raises(Exception, match="int|range|convert|large"):            # scores beyond 64 bits
            mined(spark, rows)
    assert 0 < len(mined(spark, [(i, [float(int(x)) + 0.001 for x in v], lab) for i, v, lab in rows], scale=1)) or factor == 1e9


def test_shared_ids_and_empty_tables(spark):
    rows = vectors(30, 4, 2, 3, 0.2)
    twice = rows + [(3, rows[8][1], rows[8][2]), (3, rows[9][1], 1 - rows[9][2])]
    assert all(a != p and a != n for a, _, p, _, n, _, _ in mined(spark, twice))
    assert mined(spark, []) == [] and mined(spark, [(1, [0.5], 0)]) == [] and mined(spark, [(0, [], 0), (1, [], 1)]) == []
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_texts(empty, BYTES, decoded=True).collect() == bpe.decode_ids(bpe.encode_texts(empty, BYTES), BYTES).collect() == []
    assert fim.fill_in_middle(empty).collect() == fim.fill_in_middle(empty, unit="char").collect() == []


def test_few_cells_are_read():
    """On clustered vectors the walk stops early, with the same answer as on all cells."""
    rows = vectors(4_000, 16, 5, 9, 0.05, groups=40)
    x = np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int64)
    books = (negatives.codebook(x[:, :8].astype(float), 32), negatives.codebook(x[:, 8:].astype(float), 32))
    ids, labels = np.arange(len(x)), np.array([lab for *_, lab in rows])
    index = negatives.MultiIndex(ids, ids, labels, x, books)
    read = []
    walk = index.walk
    index.walk = lambda q: (read.append(c[3] - c[2]) or c for c in walk(q))
    for i in range(0, 4_000, 200):
        got = index.best_of_label(i, labels[i], x[i], 5)
        scores = x @ x[i]
        want = sorted((-int(scores[j]), j) for j in ids if j != i and labels[j] == labels[i])[:5]
        assert [(s, j) for s, j, *_ in got] == want
    assert sum(read) < 0.2 * 20 * 4_000


def test_query_of_ids_equals_the_library(spark, library, given):  # noqa: F811
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_bpe"](spark, SF).collect()}
    assert len(got) == len(given)
    for d, t in given:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[d] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())

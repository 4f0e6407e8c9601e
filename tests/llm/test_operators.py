"""The ten operators against brute force, on a small table of awkward rows and on the given tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tidemark.llm import chat, contamination, fingerprint, jaccard, lm, packing, pii, quality, repeats, tokens
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
CLASHING = ["n", "hub", "score", "start", "text_id", "key", "block", "salt", "pii", "gid", "ids", "row", "_y"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "re", "to", "il", "es", "or", "da"]) for _ in range(r.randint(1, 4))) for _ in range(n))


LONG = prose(0, 6000)
PASSAGE = prose(1, 60)
ROWS = [
    (1, ""), (2, None), (3, " \t\n "), (4, "one"), (5, "one two"), (6, prose(2, 50)), (7, prose(2, 50)), (8, LONG),
    (9, prose(3, 30) + " " + PASSAGE + " " + prose(4, 9)), (10, PASSAGE + " " + prose(5, 40)),
    (11, "Größe Straße «é» 😀 it's x<|endoftext|>y 12345 a\x1cb c\x85d"), (12, "la la la " * 40), (13, LONG + " more"),
    (14, prose(2, 49) + " changed"), (15, "+44 20 7946 0958 x@y.example 10.0.0.300 10.1.2.3 4111 1111 1111 1111 a@b.c_d@e.f"),
    (16, "1" * 4000 + " " + "a" * 4000 + "@"), (17, PASSAGE), (18, prose(6, 20)), (19, prose(6, 20)),
]
TWICE = [*ROWS, ROWS[5], (None, PASSAGE), (9, "another text for nine " + PASSAGE)]


def frame(spark, rows):
    """Documents with extra columns whose names operators might use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def given(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]


def by_id(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: (r[0] is not None, r))


def test_token_counts(docs):
    lib = Tokenizer.from_file(PATH)
    want = [(d, len((t or "").encode()), n, n > 2048) for d, t in ROWS
            if (n := len(lib.encode(t or "", add_special_tokens=False).ids)) >= 0]
    assert by_id(tokens.count_tokens(docs, PATH), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_whole_tokens_are_proven():
    lib, whole = Tokenizer.from_file(PATH), tokens.prove_whole(PATH)
    assert len(whole) > 30_000
    assert all(lib.encode(t, add_special_tokens=False).ids == [i] for t, i in list(whole.items())[::500])


def packed_rows_are_whole(rows, texts):
    lib = Tokenizer.from_file(PATH)
    at = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = np.array([*lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(own)
        piece = own[r["start"]:r["start"] + r["length"]].tobytes()
        assert zlib.crc32(piece) == r["ids_crc32"] and (r["ids"] is None or bytes(r["ids"]) == piece)
        at[r["doc_id"]] = r["start"] + r["length"]
        assert at[r["doc_id"]] <= len(own)
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in windows.values():
        place = 0
        for offset, length in sorted(own):
            assert offset == place
            place += length
        assert place <= 2048
    return at, windows


def test_packing(docs):
    rows = packing.pack_documents(docs, PATH).collect()
    at, _ = packed_rows_are_whole(rows, dict(ROWS))
    assert set(at) == {d for d, _ in ROWS}


def test_packing_pads_little(spark, given):
    rows = QUERIES["op4_packing"](spark, SF).withColumn("ids", F.lit(None)).collect()
    at, windows = packed_rows_are_whole(rows, dict(given))
    total = sum(at.values())
    assert set(at) == {d for d, _ in given} and len(windows) * 2048 <= 1.03 * total + 2048


def test_differencing_balances():
    r = random.Random(3)
    sizes = [r.randint(1, 512) for _ in range(400)]
    windows = packing.windows_for(sizes, 2048)
    assert sorted(i for _, own in windows for i in own) == list(range(400))
    assert all(-s == sum(sizes[i] for i in own) <= 2048 for s, own in windows)
    assert min(-s for s, _ in windows) > 1900
    assert packing.windows_for([], 2048) == []


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a # b \\ <c> </turn>\n### Assistant: x"), (1, 1, "assistant", "ok \\### Assistant: </turn> ok"),
            (2, 0, "system", None), (2, 1, "tool: #<\\", "é😀"), (2, 1, "assistant", ""), (2, 1, "assistant", "z"), (3, 0, None, "t"),
            (None, 5, "assistant", "n"), (None, 4, "Assistant", "m"), (4, 0, "user", "again"), (4, 0, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    many = spark.range(25_000).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                      F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                      F.concat(F.lit("<t> "), F.col("id").cast("string")).alias("text"))
    rows += [(9, i, "assistant" if i % 2 else "user", f"<t> {i}") for i in range(25_000)]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df.drop("part").unionByName(many))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got.pop(conv)
        assert (g["n_turns"], g["turns_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got


def test_chat_parts_hold_the_template(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi #1"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    part = chat.format_chats(df).first()
    assert part["formatted"] == "### User: hi \\#1</turn>\n### Assistant: yes</turn>\n"
    start, n = part["loss_start"][0], part["loss_length"][0]
    assert part["formatted"][start:start + n] == "yes"


def test_fingerprints(spark):
    rows = [r for r in ROWS if r[0] != 8]
    got = {r["doc_id"]: r for r in fingerprint.compare_with_edits(frame(spark, rows)).collect()}
    ids = sorted(d for d, _ in rows)
    texts = {d: t or "" for d, t in rows}
    for d, after in zip(ids, [*ids[1:], ids[0]]):
        t, q = texts[d], len(texts[d]) // 4
        edited = t[:len(t) - q] + texts[after][:q]
        g = got[d]
        assert (g["n_chars"], g["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert [g["fingerprint"], g["edited_fingerprint"]] == [fingerprint.fingerprints([x.encode()])[0] for x in (t, edited)]
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
    assert got[6]["fingerprint"] == got[7]["fingerprint"] and got[6]["near_next"] == 1


def test_fingerprints_over_buckets(spark):
    rows = [(i * 3, prose(i, 40)) for i in range(50)] + [(6, prose(100, 30)), (None, "no id")]
    df = frame(spark, rows)
    found = fingerprint.with_successors(df, rows_per_bucket=4).collect()
    assert sorted(r["doc_id"] for r in found if r["side"] == 0 and r["doc_id"] is not None) == sorted(d for d, _ in rows if d is not None)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted((r["n_chars"], r["edited_sha256"]) for r in fingerprint.compare_with_edits(df).collect())
    want = [(len(t), hashlib.sha256((t[:len(t) - len(t) // 4] + n[:len(t) // 4]).encode()).hexdigest())
            for (_, t), (_, n) in zip(order, [*order[1:], order[0]])]
    assert got == sorted(want)
    assert fingerprint.compare_with_edits(frame(spark, [])).count() == 0
    alone = fingerprint.compare_with_edits(frame(spark, [(1, "just one text")])).first()
    assert alone["near_next"] == 1


def test_equal_stretches_share_phrases():
    a, b = prose(7, 400), prose(8, 35)
    x, y = fingerprint.fingerprints([a.encode(), (b + " " + a).encode()])
    assert fingerprint.likeness(x, y) > 0.8
    assert fingerprint.likeness(x, fingerprint.fingerprints([prose(9, 400).encode()])[0]) < 0.2


def test_repeats(spark, given):
    for rows in (TWICE + [(None if d is None else d + 1000, t) for d, t in given],):
        got = by_id(repeats.remove_repeats(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == sorted(brute.repeats(rows), key=lambda r: (r[0] is not None, r))
    assert repeats.remove_repeats(frame(spark, [])).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in repeats.remove_repeats(frame(spark, ROWS)).collect()}
    assert kept[17] == b"" and kept[9] is None


def test_ngram_join(spark, given):
    rows = ROWS + [(d + 1000, t) for d, t in given]
    assert by_id(jaccard.near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(rows))
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0
    assert jaccard.near_duplicates(frame(spark, TWICE)).count() == len(TWICE)


def near_copies(n):
    r, base, out = random.Random(1), prose(20, 120).split(), []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"new{r.randint(0, 10 ** 6)}"
        out.append((i, " ".join(w)))
    return out + [(1000 + i, prose(500 + i, 60) + " a very common line that many texts have in them") for i in range(12)]


def test_ngram_join_on_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "AT_ONCE", 0)              # step by step; the other tests take the rest at once
    rows = near_copies(40)
    assert by_id(jaccard.near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(rows))


def test_elias_fano():
    r = np.random.default_rng(4)
    for n, top in ((0, 10), (1, 1), (500, 40), (3000, 10 ** 9), (2000, 2 ** 50)):
        values = np.sort(r.integers(0, top, n))
        ef = lm.EliasFano.of(values)
        assert ef.get(np.arange(n)).tolist() == values.tolist()
        ask = np.concatenate([values, r.integers(0, 2 * top, 300)]).astype(np.uint64)
        at = ef.find(ask)
        known = set(values.tolist())
        assert [(x in known) for x in ask.tolist()] == (at >= 0).tolist()
        assert values[at[at >= 0]].tolist() == ask[at >= 0].tolist()


def test_language_model(spark, given):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    for rows in (TWICE, given):
        got = lm.score_texts(frame(spark, rows), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))).collect()
        got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
        want = sorted((d is not None, d or 0, *x) for (d, _), x in zip(rows, brute.bigram_scores(rows, held, lm.MU)))
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert all(abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and abs(g[6] - w[6]) < 0.001 * g[2] for g, w in zip(got, want))
    assert lm.score_texts(frame(spark, []), F.lit(False)).count() == 0


def test_personal_data(spark, given):
    for rows in (TWICE, given):
        found = pii.find_spans(frame(spark, rows), to="found").select("doc_id", "text", "score", pii.joined(F.filter("found", lambda s: s["kind"] < pii.BASE)).alias("base")).collect()
        assert len(found) == len(rows) and {r["score"] for r in found} == {"x"}
        for r in found:
            assert r["base"] == ",".join(f"{k}:{s}:{e}" for k, s, e in brute.personal(r["text"])), r["doc_id"]


def test_checksums_and_context(spark):
    rows = [(1, "konto DE89 3704 0044 0532 0130 00."), (2, "konto DE88 3704 0044 0532 0130 00."), (3, "my ssn is 123-45-6789"),
            (4, "part 123-45-6789 of"), (5, "ssn 9123-45-6789"), (6, "visa 4222222222222"), (7, "number 4222222222222")]
    df = pii.find_spans(frame(spark, rows), to="found")
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", pii.joined(F.col("found")).alias("s")).collect()}
    assert got == {1: "iban:6:33", 2: "", 3: "national_id:10:21", 4: "", 5: "", 6: "short_card:5:18", 7: ""}
    clean = {r["doc_id"]: r["t"] for r in df.select("doc_id", pii.redacted(F.col("text"), F.col("found")).alias("t")).collect()}
    assert clean[1] == "konto [IBAN]." and clean[3] == "my ssn is [NATIONAL_ID]" and clean[7] == rows[6][1]


def test_leaks(spark):
    items = [(1, PASSAGE + ". " + prose(30, 6) + "."), (2, prose(31, 16) + "."), (3, None), (4, ""), (5, prose(32, 150))]
    w = items[0][1].split()
    paraphrase = " ".join(x if i % 4 or i > 55 else f"other{i}" for i, x in enumerate(w))
    decoy = prose(33, 20) + " " + " ".join(w[5:12]) + " " + prose(34, 20)
    rows = [(1, "x " * 50 + items[0][1]), (2, paraphrase), (3, decoy), (4, None), (5, ""), (6, prose(35, 3000) + " " + items[1][1].upper() + prose(36, 200)),
            (7, prose(37, 10) + " " + items[4][1]), (8, prose(38, 500)), (6, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    df = frame(spark, rows + [(100 + i, prose(1000 + i, 300)) for i in range(60)])
    got = by_id(contamination.find_leaks(df, bench), "doc_id", "item_id")
    assert got == [(1, 1), (2, 1), (6, 2), (6, 2), (7, 5)]
    kept = contamination.without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 8, *range(100, 160)]
    assert contamination.find_leaks(frame(spark, []), bench).count() == 0
    assert contamination.find_leaks(df, bench.limit(0)).count() == 0


def test_lcs():
    a, b = prose(40, 70).split(), prose(41, 90).split()
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    raw = [[x.encode() for x in w] for w in (a, b)]
    assert contamination.lcs(contamination.masks_of(raw[0]), len(a), raw[1]) == table[-1][-1]


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op1_quality"](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 60 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_edges(spark):
    df = frame(spark, TWICE)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(df, quality.train(df, none, "quality")).collect()} == {0.5}
    labels = spark.createDataFrame([(8, 1), (13, 1), (12, 0), (16, None), (None, 0), (12, 0)], "doc_id long, quality int")
    model = quality.train(df, labels, "quality")
    scores = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert len(scores) == len({d for d, _ in TWICE}) and scores[8] > scores[12] and scores[1] == scores[2] == scores[3]
    kept = quality.keep(df, model, 0.0)
    assert kept.columns == df.columns and kept.count() == len(TWICE)
    assert quality.score(frame(spark, []), model).count() == 0


def test_trie_finds_successors_inside_a_context_only():
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, 90, (1500, 2)), axis=0)
    pairs = pairs[pairs[:, 0] % 7 != 3]                         # contexts that aren't there
    values = rng.uniform(0, 9, len(pairs))
    trie = lm.Trie(pairs[:, 0], pairs[:, 1], values)
    known = {(int(a), int(b)): v for (a, b), v in zip(pairs, values)}
    ctx, nxt = (x.ravel() for x in np.meshgrid(np.arange(95), np.arange(95)))
    got = trie.look_up(ctx, nxt)
    for a, b, g in zip(ctx.tolist(), nxt.tolist(), got.tolist()):
        want = known.get((a, b))
        assert np.isnan(g) if want is None else abs(g + want) <= 0.5 / lm.SCALE + 1e-12
    # Each context's successors are those between its pointer and the next one.
    places = trie.pointers.get(np.arange(trie.contexts.n + 1)).astype(int)
    for k, c in enumerate(trie.contexts.get(np.arange(trie.contexts.n)).tolist()):
        own = trie.successors.get(np.arange(places[k], places[k + 1])) - np.uint64(k) * trie.span
        assert own.tolist() == pairs[pairs[:, 0] == c, 1].tolist()
    empty = lm.Trie(*np.zeros((2, 0), np.int64), np.zeros(0))
    assert np.isnan(empty.look_up(np.array([1]), np.array([2]))).all()

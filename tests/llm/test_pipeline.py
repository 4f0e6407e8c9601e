"""The pipeline's stages, one by one, against plain checks of what each may change."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tidemark.llm import jaccard, pii
from tidemark.session import gathered

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    rows = {n: {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for n, d in kept.items() if n != "packing"}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(quality.get(d, 1) for d in rows["quality"]) >= 0.95 * len(rows["quality"])
    comps = brute.jaccard_components(list(rows["quality"].items()), 5, 80)
    assert set(rows["near_duplicates"]) == {c for _, _, c in comps}
    assert set(rows["personal_data"]) == set(rows["decontamination"]) <= set(rows["near_duplicates"])
    for d, text in rows["personal_data"].items():
        spans = brute.personal(rows["decontamination"][d])
        assert (text != rows["decontamination"][d]) or not spans
    assert {r["doc_id"] for r in kept["packing"].collect()} == set(rows["personal_data"])
    assert all(k.upper() for k in pii.KINDS)


def test_duplicates_go_only_for_their_own_text(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(2, "one two three four"), (2, "five six seven eight nine"), (3, "one two three four"), (4, long), (5, long + " w60"), (5, "other words entirely here"),
            (6, None), (6, None), (7, ""), (None, long), (None, "alone"), (8, "five six seven eight nine"), (8, "five six seven eight nine"),
            (9, "other words entirely here"), (10, "kept"), (10, "kept"), (1, "late first text"), (11, "late first text"), (11, "own"), (11, "another own")]
    clashing = ["_key", "_row", "_first", "_pii", "_pii_0", "pii", "component_id", "n", "cls"]
    docs = spark.createDataFrame([(d, t, *["x"] * len(clashing)) for d, t in rows],
                                 "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in clashing)).repartition(3)
    kept = corpus_pipeline.duplicates_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    # Every text stays exactly once, but those linked with another one, and texts without words or an id, which stay as they are.
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(3, "one two three four"), (2, "five six seven eight nine"), (4, long), (5, "other words entirely here"), (6, None), (7, ""),
                          (None, long), (None, "alone"), (10, "kept"), (1, "late first text"), (11, "own"), (11, "another own")], key=str)
    redacted = corpus_pipeline.pii_stage(spark, docs.withColumn("text", F.lit("mail a@b.example now")), SF)
    assert redacted.columns == docs.columns and {tuple(r)[1:] for r in redacted.collect()} == {("mail [EMAIL] now", *["x"] * len(clashing))}


def test_no_text_of_a_shared_id_is_looked_up(spark, monkeypatch):
    seen, plain = [], corpus_pipeline.lookup_join
    monkeypatch.setattr(corpus_pipeline, "lookup_join", lambda fact, lookup, *a, **k: seen.append(lookup.columns) or plain(fact, lookup, *a, **k))
    docs = spark.createDataFrame([(1, "a long text"), (1, "another long text"), (2, "b"), (None, "b")], "doc_id long, text string")
    assert corpus_pipeline.duplicates_stage(spark, docs, SF).count() == 4
    assert seen and all(columns == ["doc_id"] for columns in seen)


def test_links_are_read_by_as_few_tasks_as_they_ask_for(spark, monkeypatch):
    seen, plain = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda links: seen.append(links.rdd.getNumPartitions()) or plain(links))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(i, f"one two three four five {i // 2}") for i in range(40)], "doc_id long, text string")
        found = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {i: i // 2 * 2 for i in range(40)}
    assert seen and set(seen) == {1}
    assert gathered(spark.range(10, numPartitions=7), 4).rdd.getNumPartitions() == 3


def test_run_registers_and_ends(spark):
    import __spark_entry__ as contract
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in contract.queries() if q.startswith("op")}
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = docs if name == "packing" else out

import gzip
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.cohort import CohortRule
from tidemark.operators.measure import score_text
from tidemark.plans.study import build_analysis
from tidemark.sources import raw_reviews as rr, split_csv as sc, tables as tb
from tidemark.streaming import jobs
from tests.test_text import FILL

HEAD = "listing_id,id,date,reviewer_id,reviewer_name,comments\n"
COLUMNS = HEAD.strip().split(",")


def files(folder, last=True):
    folder.mkdir(exist_ok=True)
    (folder / "Bergen.csv").write_text(HEAD + '1,10,2015-01-01,7,Ann,"two\nlines, ""quoted"""\n1,11x,2015-01-02,7,Ann,bad\n'
                                       '1,9007199254740993,2015-13-01,7,Ann,bad\n2,9007199254740993,2015-03-01,8,Bo,ok,extra,more\n'
                                       '3,12.0,2016-01-01,7\n')
    with gzip.open(folder / "Århus N.csv.gz", "wt", encoding="utf-8") as f:
        f.write(HEAD + f"5,20,2015-06-01,9,Cy,{FILL.replace(',', '')} lovely\n5,21,2016-06-01,9,Cy,again\n")
    if last:
        (folder / "Cork.csv").write_text(HEAD + "6,30,2015-02-01,4,Di,fine\n")


def test_registry_numbers_files_in_name_order(spark, tmp_path):
    files(tmp_path / "raw")
    got = [(r["city_id"], r["city"], r["slug"]) for r in rr.registry(spark, str(tmp_path / "raw")).orderBy("city_id").collect()]
    assert got == [(0, "Bergen", "Bergen"), (1, "Cork", "Cork"), (2, "Århus N", "Arhus_N")]


def test_scan_pads_short_rows_cuts_long_ones_and_counts_rejects(spark, tmp_path):
    files(tmp_path / "raw")
    folder = str(tmp_path / "raw")
    cities = rr.registry(spark, folder)
    rows = rr.with_city(rr.scan(spark, rr.layouts(spark, [r["path"] for r in cities.collect()])), cities)
    good = {(r["city_id"], r["review_id"]) for r in rr.metadata(rows).collect()}
    assert good == {(0, 10), (0, 9007199254740993), (0, 12), (2, 20), (2, 21), (1, 30)}
    assert {r["city_id"]: (r["n_read"], r["n_dropped"]) for r in rr.rejects(rows).collect()} == {0: (5, 2), 1: (1, 0), 2: (2, 0)}
    text = {r["review_id"]: r["comments"] for r in rr.texts(rows).collect()}
    assert text[10] == 'two\nlines, "quoted"' and text[12] is None


def test_columns_are_found_by_name_and_odd_files_left_out(spark, tmp_path):
    files(tmp_path, last=False)
    (tmp_path / "Cork.csv").write_text("comments,reviewer_id,id,date,listing_id\nfine,4,30,2015-02-01,6\n")
    (tmp_path / "Derry.csv").write_text("id,date\n1,2015-02-01\n")
    cities = rr.registry(spark, str(tmp_path))
    rows = rr.metadata(rr.with_city(rr.scan(spark, rr.layouts(spark, [r["path"] for r in cities.collect()])), cities)).collect()
    assert {(r["city_id"], r["listing_id"], r["review_id"], r["reviewer_id"]) for r in rows if r["city_id"] in (1, 2)} == {(1, 6, 30, 4)}
    assert len(rows) == 6


def test_cells_of_plain_records_are_those_of_the_parser(spark):
    plain = ["a,b,c", "a,,c", "a,b", "a", "a,b,", "a,b,c,d,e", "a, b ,c ", "é,ß,'x'", 'a,b,"c"', 'a,b,"c, ""d"" e"', 'a,b,"two\nlines"', '"only, one"', 'a,"""b"""',
             'a,b," c "', "a,#b,c\\", 'a,"b\\"', "#a,b,c", "a,b\tc,d", 'a,"\n"', 'a,b,"x,\n\n""y"""', 'a,"\t,"']
    other = ["", " a,b", "a,b\r", 'a,""', 'a,"b",c', 'a,b"c', 'a,"b"c', 'a,"b', 'a,b "c"', 'a,"b""', "\0a,b", 'a,"b"c"', '"', 'a,b,"c\r\nd"']
    assert [t for t in plain if sc.cells_of(t, range(4)) is None] == [] and [t for t in other if sc.cells_of(t, range(4)) is not None] == []
    options = {k: v for k, v in rr.OPTIONS.items() if k != "header"}
    rows = spark.createDataFrame([(t,) for t in plain], "t string").select("t", F.from_csv("t", "c0 string, c1 string, c2 string, c3 string", options).alias("r"))
    for r in rows.collect():
        assert sc.cells_of(r["t"], range(4)) == list(r["r"]), r["t"]
        assert sc.cells_of(r["t"], [2, 0]) == [r["r"]["c2"], r["r"]["c0"]]


def test_plain_records_need_no_parser_and_files_are_surveyed_once(spark, tmp_path, monkeypatch):
    files(tmp_path)
    cities = rr.registry(spark, str(tmp_path))
    paths = [r["path"] for r in cities.collect()]
    blocks = sc.survey(spark, paths)
    told = sc.records(spark, paths, blocks, {r["file"]: [1] for r in cities.collect()}).collect()
    assert sorted(r["cells"][0] for r in told if r["cells"]) == ["10", "11x", "12.0", "20", "21", "30", "9007199254740993", "9007199254740993"]
    assert all(r["record"] is None for r in told)
    from catalog import tables
    seen, plain = [], rr.survey
    monkeypatch.setattr(rr, "survey", lambda *a: seen.append(1) or plain(*a))
    assert tables.csv_texts(spark, "/root/testdata/sf0.001").count() > 0 and len(seen) == 1


def test_ingest_skips_finished_cities(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "meta")
    files(raw)
    assert rr.ingest(spark, str(raw), out).count() == 6
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "meta").rglob("*.parquet")}
    (raw / "Cork.csv").write_text("broken")
    (raw / "Derry.csv").write_text("id,date\n1,2015-02-01\n")
    (raw / "Zug.csv").write_text(HEAD + "9,40,2015-02-01,4,Ed,new\n")
    assert rr.ingest(spark, str(raw), out).count() == 7
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "meta").rglob("*.parquet")}
    assert before.items() <= after.items()
    known = {r["file"]: r["city_id"] for r in rr.written_registry(spark, out).collect()}
    assert known == {"Bergen.csv": 0, "Cork.csv": 1, "Århus N.csv.gz": 2, "Zug.csv": 4}


def test_raw_files_to_analysis_table(spark, tmp_path):
    raw = tmp_path / "raw"
    files(raw)
    rule = CohortRule(per_1000=1000, start_day=0, censor_day=20000)
    for name, short_cut in (("a", False), ("b", True)):
        rows = build_analysis(spark, str(raw), str(tmp_path / name), rule, short_cut).collect()
        assert [(r["review_id"], r["city"], r["hits_ATT"], r["y_revisit"]) for r in rows] == [(20, "Århus N", 1, 1)]


def test_ledger_keeps_the_first_result(spark, tmp_path):
    book = tb.Ledger(spark, str(tmp_path / "l"), ["k"])
    assert book.table() is None and book.done() == set()
    book.append(spark.createDataFrame([("a", 1)], "k string, v int"))
    book.append(spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int"))
    assert {tuple(r) for r in book.table().collect()} == {("a", 1), ("b", 3)} and book.done() == {("a",), ("b",)}


def test_reports_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "k string, v int")
    tb.write_report(df, str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.csv"))) == 1
    tb.write_run_metadata(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["v"] == 1
    empty = tb.empty_table(spark, "review_id long, comments string")
    tb.write_table(empty, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).schema == empty.schema and score_text(empty).count() == 0


def test_checkpoint_folder_of_the_session_is_used(spark):
    from tidemark.session import checkpointed
    folder = spark.sparkContext.getCheckpointDir()
    assert checkpointed(spark.range(3)).count() == 3
    assert folder is None or spark.sparkContext.getCheckpointDir() == folder


def test_incremental_ingest_reads_new_files_once(spark, tmp_path):
    raw, out, mark = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "mark")
    files(raw, last=False)
    jobs.ingest_new_files(spark, str(raw), out, mark, COLUMNS).awaitTermination(120)
    assert spark.read.parquet(out).count() == 5
    (raw / "Cork.csv").write_text(HEAD + "6,30,2015-02-01,4,Di,fine\n")
    jobs.ingest_new_files(spark, str(raw), out, mark, COLUMNS).awaitTermination(120)
    assert spark.read.parquet(out).count() == 6


def test_streamed_scores_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, FILL + " lovely" * (i % 3)) for i in range(20)], "review_id long, comments string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.score_stream(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, score_text(df).collect()))


def test_streamed_returns_equal_batch(spark, tmp_path):
    firsts = spark.createDataFrame([(1, "2020-01-01", 5), (2, "2020-01-10", 6)], "reviewer_id long, t0 string, listing_id long")
    later = spark.createDataFrame([(1, 10, "2020-03-30", 5), (1, 11, "2020-03-31", 5), (1, 11, "2020-03-31", 5), (1, 12, "2021-12-31", 9),
                                   (1, 13, "2022-01-01", 5), (2, 14, "2020-02-01", 6)], "reviewer_id long, review_id long, ts string, listing_id long")
    firsts.withColumn("t0", F.to_timestamp("t0")).write.parquet(str(tmp_path / "f"))
    later.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "l"))

    def stream(name, schema):
        return spark.readStream.schema(schema).parquet(str(tmp_path / name))
    found = jobs.returns_in_window(stream("f", "reviewer_id long, t0 timestamp, listing_id long"),
                                   stream("l", "reviewer_id long, review_id long, ts timestamp, listing_id long"))
    (found.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "m"))
     .trigger(availableNow=True).start().awaitTermination(120))
    assert {(r["review_id"], r["same_listing"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {(11, True), (12, False)}


def test_ranges_of_a_file_equal_the_whole_file(spark, tmp_path):
    """Ranges of a few bytes cut fields, quotes and line breaks at every place; the result is that of the one-task reader."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        text = "".join(rng.choice(['a', 'é', ',', '""', '\n', '\n\n', ' ', "x"]) for _ in range(rng.randrange(60)))
        rows.append(f'{i},{i + 1000},2015-01-01,{i % 7},Ann,"{text}"')
    (tmp_path / "Big.csv").write_text(HEAD + "\n".join(rows[:40]) + "\n\n" + "\n".join(rows[40:]) + "\n")
    (tmp_path / "Crlf.csv").write_text("comments,id\r\n\"one\"\"s\",1\r\n,2\r\n", newline="")
    big, crlf = (str(tmp_path / n) for n in ("Big.csv", "Crlf.csv"))
    want = spark.read.options(**rr.OPTIONS).csv(big).select(*rr.RAW).collect()
    assert len(want) == 60
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (11, 150):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            blocks = sc.survey(spark, [big])
            assert blocks.agg(F.sum("n_records")).first()[0] == 61 and blocks.count() > 9
            got = rr.scan(spark, rr.layouts(spark, [big], blocks=blocks), blocks=blocks).select(*rr.RAW).collect()
            assert sorted(map(repr, got)) == sorted(map(repr, want))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = rr.scan(spark, rr.layouts(spark, [crlf], ["id", "comments"]), ["id", "comments"]).select("id", "comments").collect()
    assert sorted(map(tuple, got)) == [("1", 'one"s'), ("2", None)]
    assert sc.survey(spark, []).count() == 0 and rr.scan(spark, {}).count() == 0


def test_files_with_unpaired_quotes_are_read_whole_and_others_refused_by_name(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "meta")
    files(raw)
    (raw / "Derry.csv").write_text("id,date\n1,2015-02-01\n")
    (raw / "Ely.csv.gz").write_bytes(gzip.compress(b""))
    (raw / "Fez.csv").write_text(HEAD + '8,50,2015-02-01,4,Di,5" pipe\n8,51,2015-02-01,4,Di,fine\n8,x,2015-02-01,4,Di,bad\n')
    assert rr.ingest(spark, str(raw), out).count() == 8
    known = {r["city_id"]: r["file"] for r in rr.written_registry(spark, out).collect()}
    rejects = {known[r["city_id"]]: (r["n_read"], r["n_dropped"]) for r in spark.read.parquet(f"{out}.rejects").collect()}
    assert rejects == {"Bergen.csv": (5, 2), "Cork.csv": (1, 0), "Fez.csv": (3, 1), "Århus N.csv.gz": (2, 0)}
    assert {tuple(r) for r in spark.read.parquet(f"{out}.refused").collect()} == {
        ("Derry.csv", "no column listing_id, reviewer_id"), ("Ely.csv.gz", "empty")}


def test_streamed_ingest_finds_columns_by_header_and_repeats_add_nothing(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    files(raw, last=False)
    (raw / "Cork.csv").write_text("comments,reviewer_id,id,date,listing_id\nfine,4,30,2015-02-01,6\n")
    (raw / "Derry.csv").write_text("id,date\n1,2015-02-01\n")
    jobs.ingest_new_files(spark, str(raw), out, str(tmp_path / "mark")).awaitTermination(120)
    want = {tuple(r) for r in rr.ingest(spark, str(raw), str(tmp_path / "batch")).collect()}
    assert {tuple(r) for r in spark.read.parquet(out).select(*rr.META).collect()} == want and len(want) == 6
    jobs.ingest_new_files(spark, str(raw), out, str(tmp_path / "fresh mark")).awaitTermination(120)     # all files once more
    assert spark.read.parquet(out).count() == 6 and rr.written_registry(spark, out).count() == 3


def test_streamed_scores_read_documents_in_a_folder_or_in_one_file(spark, tmp_path):
    from catalog.text import streamed_scores
    docs = spark.createDataFrame([(8 * i, "We were here and the stay was good for all of us. " * 3, "en", "a", 150) for i in range(3)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    for folder in ("many", "one"):
        assert sorted(r["doc_id"] for r in streamed_scores(spark, str(tmp_path / folder)).collect()) == [0, 8, 16]


def test_raw_files_of_the_queries_are_smaller_than_their_texts(spark, tmp_path):
    """Every review carries a whole text; the files come back whole through the ingest."""
    import datetime
    from catalog import tables as ct
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    save("documents", [(i, " ".join(rng.choices(words, k=300)) + '\n"a", b') for i in range(40)], "doc_id long, text string")
    spark.read.parquet(str(tmp_path / "documents.parquet")).selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars").coalesce(1).write.parquet(str(tmp_path / "d2"))
    (tmp_path / "documents.parquet").rename(tmp_path / "d1")
    (tmp_path / "d2").rename(tmp_path / "documents.parquet")
    save("orders", [(i, i % 7, datetime.datetime(1996, 1, 1 + i % 28)) for i in range(40)], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    save("lineitem", [(i, i % 3) for i in range(40)], "l_orderkey long, l_suppkey long")
    save("supplier", [(i, i) for i in range(3)], "s_suppkey long, s_nationkey int")
    folder = ct._raw_files(spark, str(tmp_path))
    size = sum(f.stat().st_size for f in pathlib.Path(folder.removeprefix("file:")).glob("part-*"))
    assert size < 40 * 300 * 7 * 0.7
    back = rr.texts(rr.with_city(rr.scan(spark, rr.layouts(spark, [r["path"] for r in rr.registry(spark, folder).collect()])), rr.registry(spark, folder)))
    want = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert back.count() == 40 and back.join(want, (F.col("review_id") == F.col("doc_id")) & F.startswith("comments", "text")).count() == 40


def test_one_row_group_is_spread_although_its_file_has_many_splits(spark, tmp_path):
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        read = spark.read.parquet(f"{tmp_path}/one")
        assert read.rdd.getNumPartitions() >= 4
        spread = tb.spread_if_few(read)
        held = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
        assert max(held) <= 2000 and sum(held) == 4000
        assert spread.columns == ["id", "text"] and spread.exceptAll(read).count() == 0
        even = spark.range(0, 4000, 1, 8)
        assert tb.spread_if_few(even) is even                      # even splits aren't shuffled
        assert tb.spread_if_few(read.filter("id < 0")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)

import json

import pytest
from pyspark.sql import functions as F

from ragspark.operators.catalog import lookup, merge_counts, merge_plan
from ragspark.operators.embedding import hashing_embedder
from ragspark.plans import journals, passages
from ragspark.plans.staged import fingerprint, manifest, run_stages
from ragspark.sources import files, tables
from ragspark.streaming.incremental import live_active_book, maintain_index


def test_search_payloads(spark, tmp_path):
    result = {"url": "u", "title": "t", "content": "c", "score": 0.7, "raw_content": None}
    (tmp_path / "a.json").write_text(json.dumps({"query": "x", "tavily_response": {"results": [result, {**result, "url": "v"}]}}))
    (tmp_path / "b.json").write_text(json.dumps({"query": "", "tavily_response": {"results": [result]}}))
    (tmp_path / "c.json").write_text(json.dumps({"query": "y"}))
    rows, rejected = files.search_payloads(spark, str(tmp_path))
    got = sorted((r.query_id, r.query, r.pos, r.url, float(r.score)) for r in rows.collect())
    assert got == [("a.json", "x", 0, "u", .7), ("a.json", "x", 1, "v", .7), ("b.json", "UNKNOWN_QUERY", 0, "u", .7)]
    assert [r.query_id for r in rejected.collect()] == ["c.json"]


def test_chunk_files(spark, tmp_path):
    chunks = [{"chunk_id": 0, "text": " long enough text "}, {"text": "no id at all"}, {"chunk_id": 2, "text": " "},
              {"chunk_id": 3, "text": "short"}, {"chunk_id": 4, "text": "x" * 9000}]
    (tmp_path / "book-12_chunks.json").write_text(json.dumps({"total_chunks": 5, "chunks": chunks}, indent=1))
    got = {r.chunk_id: r for r in files.chunk_files(spark, str(tmp_path)).collect()}
    assert {k: r.reason for k, r in got.items()} == {0: None, None: "missing_id", 2: "empty", 3: "too_short", 4: None}
    assert got[0].book_uid == "book-12" and got[0].text == "long enough text" and len(got[4].text) == 8192


def test_query_files(spark, tmp_path):
    full = {"query_id": "1", "query": "q", "book": "b", "results": []}
    (tmp_path / "a.json").write_text(json.dumps(full))
    (tmp_path / "b.json").write_text(json.dumps({k: v for k, v in full.items() if k != "book"}))
    (tmp_path / "c.json").write_text("{broken")
    good, bad = files.query_files(spark, str(tmp_path))
    assert [r.query_id for r in good.collect()] == ["1"]
    assert {r.file: r.reason for r in bad.collect()} == {"b.json": "missing book", "c.json": "invalid json"}


def test_text_corpus_and_order(spark, tmp_path):
    for name in ("book-2.txt", "cleaned_book-10.txt", "notes.txt"):
        (tmp_path / name).write_text(f"{name}\nline two")
    books = files.text_corpus(spark, str(tmp_path))
    assert {r.book_uid: r.text for r in books.collect()}["book-10"] == "cleaned_book-10.txt\nline two"
    assert [r.book_uid for r in files.natural_order(books).collect()] == ["book-1", "book-2", "book-10"]


def test_index_books_overwrites_only_its_books(spark, tmp_path):
    path = str(tmp_path / "vectors")
    text = " ".join(f"word{i}" for i in range(400))
    both = spark.createDataFrame([("book-1", text), ("book-2", text)], "book_uid string, text string")
    report = {r.book_uid: r for r in passages.index_books(both, hashing_embedder(16), path).collect()}
    assert report["book-1"].total_embeddings > 1 and report["book-1"].all_normalized and report["book-1"].max_dim == 16
    shorter = spark.createDataFrame([("book-2", "one short text of some words only")], "book_uid string, text string")
    passages.index_books(shorter, hashing_embedder(16), path)
    counts = {r.book_uid: r["count"] for r in spark.read.parquet(path).groupBy("book_uid").count().collect()}
    assert counts == {"book-1": report["book-1"].total_embeddings, "book-2": 1}


def test_insert_if_absent_twice(spark, tmp_path):
    path = str(tmp_path / "index")
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "book_id int, summary string")
    tables.insert_if_absent(batch, path, "book_id")
    tables.insert_if_absent(batch.union(spark.createDataFrame([(3, "c")], batch.schema)), path, "book_id")
    assert sorted(r.book_id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_only_new_rows_are_embedded(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def embedder(rows, text, out):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        marked = rows.withColumn(out, F.array(F.lit(1.0)))
        return marked.mapInArrow(count, marked.schema)

    path, batch = str(tmp_path / "index"), spark.createDataFrame([(i, "t") for i in range(10)], "book_id int, summary string")
    for _ in range(2):
        fresh = tables.insert_if_absent(batch.union(batch), path, "book_id", lambda rows: embedder(rows, "summary", "embedding"))
        fresh.count(), fresh.collect()
    assert seen.value == 10 and spark.read.parquet(path).count() == 10


def test_paper_index_grows(spark, tmp_path):
    path = str(tmp_path / "papers")
    columns = "query_id int, pos int, title string, doi string, year int, abstract string, citations int, publisher string, " \
              "is_oa boolean, pdf string"
    first = spark.createDataFrame([(1, 0, "T one", "", 2000, "abc def", 5, "IEEE", True, None)], columns)
    other = spark.createDataFrame([(1, 0, "T two", "10.1/x", 2001, "x y", 7, "", False, None),
                                   (2, 0, "T three", None, None, None, None, None, None, None),
                                   (2, 1, "T three", "10.1/z", None, None, None, None, None, None)], columns)
    candidates = journals.collect_candidates(first, other)
    assert sorted(r.title for r in candidates.collect()) == ["T one", "T three"]
    for _ in range(2):
        index = journals.grow_index(candidates, path, hashing_embedder())
    assert index.count() == 2 and {len(r.paper_id) for r in index.collect()} == {64}
    shown = journals.recommend_papers(spark.createDataFrame([(1, "abc T")], "query_id int, query string"), index, hashing_embedder())
    assert [r.title for r in shown.orderBy("rank").collect()] == ["T one", "T three"]


def test_envelope_parts(spark):
    asked = spark.createDataFrame([("a", "x"), ("b", "y")], "query_id string, query string")
    rows = spark.createDataFrame([("a", i, f"u{i}") for i in range(5)], "query_id string, pos int, url string")
    got = tables.envelope(asked, rows, "s", ["url"], "pos", F.expr("timestamp'2026-01-02 03:04:05'"), size=2)
    sizes = sorted((r.query_id, r.part, r.num_rows, [x.url for x in r.rows]) for r in got.collect())
    assert sizes == [("a", 0, 5, ["u0", "u1"]), ("a", 1, 5, ["u2", "u3"]), ("a", 2, 5, ["u4"]), ("b", 0, 0, [])]


def test_merge(spark):
    schema = "id int, uid string, title string, author string, isbn string, topic string, description string, " \
             "cover_image_url string, published_year int"

    def book(i, uid, isbn, title="t"):
        return (i, uid, title, "a", isbn, None, None, None, 2000)
    held = spark.createDataFrame([book(1, "book-1", "i1"), book(2, "book-2", "i2"), book(3, "book-3", None), book(4, "own", None),
                                  book(5, "book-5", None)], schema)
    canonical = spark.createDataFrame([book(0, "book-1", "i1"), book(0, "new-2", "i2"), book(0, "book-9", None),
                                       book(0, "book-5", None, "other")], schema)
    plan = merge_plan(held, canonical)
    got = {r.uid: (r.id, r.action) for r in plan.collect()}
    assert got == {"book-1": (1, "unchanged"), "new-2": (2, "update"), "book-9": (None, "insert"), "book-5": (5, "update"),
                   "book-3": (3, "delete"), "own": (4, "keep")}
    assert {r.action: r.rows for r in merge_counts(plan).collect()}["update"] == 2
    refs = spark.createDataFrame([("book-1",), ("4",), ("x",)], "ref string")
    assert sorted((r.ref, r.id) for r in lookup(refs, held).collect()) == [("4", 4), ("book-1", 1)]


def test_stages_resume(spark, tmp_path):
    calls = []

    def step(name):
        def run(df):
            calls.append(name)
            return df.withColumn(name, F.lit(len(calls)))
        return name, run
    stages = [step("one"), step("two"), step("three")]
    run_stages(stages, spark.range(2), str(tmp_path))
    out = run_stages(stages, spark.range(2), str(tmp_path), start="three")
    assert calls == ["one", "two", "three", "three"] and out.columns == ["id", "one", "two", "three"]
    with pytest.raises(ValueError):
        run_stages(stages, spark.range(2), str(tmp_path), start="four")


def test_stages_resume_after_a_failure(spark, tmp_path):
    calls, folder = [], str(tmp_path)

    def step(name, dies=False):
        def run(df):
            calls.append(name)
            out = df.withColumn(name, F.col("id") * 2)
            return out.withColumn("bad", F.when(F.col("id") == 90, F.raise_error(F.lit("died")))).drop("id") if dies else out
        return name, run
    source = spark.range(100, numPartitions=4)
    with pytest.raises(Exception, match="died"):
        run_stages([step("one"), step("two"), step("three", dies=True)], source, folder)
    assert manifest(spark, folder, "two") and manifest(spark, folder, "three") is None
    stages = [step("one"), step("two"), step("three")]
    calls.clear()
    straight = run_stages(stages, source, str(tmp_path / "other"))
    calls.clear()
    resumed = run_stages(stages, source.repartition(3), folder, resume=True)
    assert calls == ["three"] and sorted(resumed.collect()) == sorted(straight.collect())
    calls.clear()
    run_stages(stages, source, folder, resume=True)
    assert calls == []
    run_stages(stages, source, folder, start="two", resume=False)
    assert calls == ["two", "three"]
    calls.clear()
    run_stages(stages, source.where("id < 99"), folder, resume=True)
    assert calls == ["one", "two", "three"]
    with pytest.raises(ValueError, match="no committed table"):
        run_stages(stages, source, str(tmp_path / "third"), start="two")
    with pytest.raises(ValueError, match="differ"):
        run_stages([step("one"), step("one")], source, folder)


def test_fingerprints(spark):
    rows = spark.createDataFrame([(1, {"a": 1}, [1.5]), (2, None, None)], "i int, m map<string, int>, v array<double>")
    same = fingerprint(rows)
    assert fingerprint(rows.orderBy(F.desc("i"))) == same
    others = [rows.union(rows), rows.withColumn("i", F.col("i") + 1), rows.withColumnRenamed("i", "j"), rows.where("i = 1"),
              rows.withColumn("m", F.lit(None).cast("map<string, int>")), rows.where("false")]
    assert len({same, *map(fingerprint, others)}) == 7


def test_large_text_files_in_segments(spark, tmp_path):
    lines = [("" if i % 40 == 39 else f"line {i} " + "x" * (i % 97)) + ("\r" if i % 5 == 0 else "") for i in range(40_000)]
    lines[777] = "long " * 20_000
    texts = {"book-7.txt": "\n".join(lines), "notes.txt": "one\n\n\ntwo\n", "book-8.txt": "", "book-9.txt": "\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        segments = files.text_segments(spark, str(tmp_path), chars=5000)
        assert segments.rdd.getNumPartitions() >= 10
        rows = sorted(segments.collect(), key=lambda r: (r.file, r.block, r.part))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    joined = {name: "\n".join(r.text for r in rows if r.file.endswith("/" + name)) for name in texts}
    assert joined == {name: text.removesuffix("\n") for name, text in texts.items()}
    book = [r for r in rows if r.book_uid == "book-7"]
    assert len({r.block for r in book}) >= 10 and len({(r.block, r.part) for r in book}) == len(book)
    assert all(len(r.text) < 10_200 for r in book if "long long" not in r.text)
    assert {r.book_uid for r in rows if r.file.endswith("/notes.txt")} == {"book-1"}


def test_stream_maintains_the_index(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "book_id int, summary string"
    for round_ in range(2):
        batch = spark.createDataFrame([(1, "red bolt"), (2 + round_, "blue")], schema)
        batch.write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        run = maintain_index(stream, hashing_embedder(), "summary", "book_id", index, str(tmp_path / f"cp{round_}"))
        run.trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.book_id for r in spark.read.parquet(index).collect()) == [1, 2, 3]


def test_live_active_book(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    path = str(tmp_path / "events")
    events.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    live = live_active_book(stream, "user_id", "event_type", "ts", "event_id")
    run = live.writeStream.outputMode("update").format("memory").queryName("live").trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("v"))
    seen = {}
    for r in spark.sql("select * from live").collect():
        seen[r.user_id] = r.active_book  # update mode: later rows replace earlier ones
    assert seen == {r.user_id: r.v for r in last.collect()}

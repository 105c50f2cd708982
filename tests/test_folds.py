"""The chunk folds over many segments against plain loops, and rows judged once."""

from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.operators import chunking, quality

SIZES = [320 + i if i % 50 == 7 else 20 + 7 * i * i % 180 for i in range(700)]


def windows(sizes):
    done, window = [], []
    for n in sizes:
        if n > fv.CHUNK_MAX_TOKENS:
            done += [min(fv.CHUNK_MAX_TOKENS, n - at) for at in range(0, n, fv.CHUNK_MAX_TOKENS)]
        elif sum(window) + n <= fv.CHUNK_MAX_TOKENS:
            window.append(n)
        else:
            if sum(window) >= fv.CHUNK_MIN_TOKENS:
                done.append(sum(window))
            window = [m for i, m in enumerate(window) if sum(window[i + 1:]) < fv.CHUNK_OVERLAP_TOKENS] + [n]
    if window:
        last = sum(window)
        if last < fv.CHUNK_MIN_TOKENS and done and done[-1] + last <= fv.CHUNK_MERGE_LIMIT:
            done[-1] += last
        else:
            done.append(last)
    return done


def merged(sizes):
    done, held = [], None
    for n in sizes:
        if held is not None:
            done += [held + n] if held + n <= fv.CHUNK_MERGE_LIMIT else [held, n]
            held = None
        elif n >= fv.CHUNK_MIN_TOKENS:
            done.append(n)
        elif done and done[-1] + n <= fv.CHUNK_MERGE_LIMIT:
            done[-1] += n
        else:
            held = n
    return done + ([] if held is None else [held])


def test_folds_over_segments(spark):
    text = "\n".join(" ".join([f"W{i}", *(f"w{k}" for k in range(n - 2)), "end."]) for i, n in enumerate(SIZES))
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc int, text string")
    chunked = chunking.window_chunks(rows, "text")
    found = {r.doc: r.t for r in chunked.select("doc", F.col("chunks.tok").alias("t")).collect()}
    assert found[1] == windows(SIZES) and not found[2] and found[3] == []
    again = chunking.merge_small(chunked).where("doc = 1").select(F.col("chunks.tok").alias("t")).first().t
    assert again == merged(windows(SIZES))


def test_small_chunks_merge_over_segments(spark):
    sizes = [30 + 11 * i * i % 460 for i in range(500)]
    parts = F.array(*[F.struct(F.lit(f"c{i}").alias("text"), F.lit(n).alias("tok"), F.lit(i).alias("section")) for i, n in enumerate(sizes)])
    row = chunking.merge_small(spark.range(1).select(parts.alias("chunks"))).first()["chunks"]
    assert [c.tok for c in row] == merged(sizes)
    assert "\n\n".join(c.text for c in row).split("\n\n") == [f"c{i}" for i in range(len(sizes))]


def test_rows_are_judged_in_one_scan(spark, tmp_path):
    rows = [("q", "fact", i, "https://a.example", 0.9, "fact " * n) for i, n in enumerate([300, 1, 400, 5, 2])]
    spark.createDataFrame(rows, "query_id string, query string, pos int, url string, score double, content string") \
        .write.parquet(str(tmp_path / "r"))
    judged = quality.judged(spark.read.parquet(str(tmp_path / "r")))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("pronoun") <= 1
    assert sorted((r.pos, r["_strict"]) for r in judged.collect()) == [(0, False), (1, False), (2, False)]

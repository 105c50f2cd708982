import random

import pytest
from pyspark.sql import functions as F

from ragspark.operators import chunking


def sentence(n, k):
    return f"W{k} " + " ".join(f"w{i}" for i in range(n - 2)) + " end."


def chunks(spark, sizes, merge):
    text = "\n".join(sentence(n, k) for k, n in enumerate(sizes))
    rows = spark.createDataFrame([(1, 0, "u", 1.0, text)], "query_id int, pos int, url string, score double, content string")
    found = chunking.chunk_results(rows, merge=merge).orderBy("part").collect()
    return [(r.section_index, r.token_estimate) for r in found], [r.chunk_text for r in found]


def test_overlapping_windows(spark):
    got, texts = chunks(spark, [60] * 7, merge=False)
    assert got == [(0, 300), (1, 180)]
    assert texts[1].split("\n\n")[0].startswith("W4 ")


def test_short_window_is_lost_on_overflow(spark):
    got, texts = chunks(spark, [100, 90, 250], merge=False)
    assert got == [(0, 340)] and "W0 " not in texts[0]


def test_oversized_block(spark):
    assert chunks(spark, [50, 310, 40], merge=False)[0] == [(0, 300), (1, 100)]
    assert chunks(spark, [50, 310, 40], merge=True)[0] == [(0, 400)]
    assert chunks(spark, [60] * 7, merge=True)[0] == [(0, 300), (1, 180)]


def test_small_chunk_merges_forward(spark):
    parts = F.expr("""array(named_struct('text', 'a', 'tok', 400, 'section', 0), named_struct('text', 'b', 'tok', 100, 'section', 1),
                            named_struct('text', 'c', 'tok', 300, 'section', 2), named_struct('text', 'd', 'tok', 190, 'section', 3))""")
    row = chunking.merge_small(spark.range(1).select(parts.alias("chunks"))).first()["chunks"]
    assert [(c.text, c.tok, c.section) for c in row] == [("a", 400, 0), ("b\n\nc", 400, 1), ("d", 190, 3)]


def test_character_split(spark):
    text = "\n".join(" ".join(f"word{i}-{j}" for j in range(12)) + ". Next one" for i in range(60)) + "x" * 1200
    rows = spark.createDataFrame([("book-1", text)], "book_uid string, text string")
    got = chunking.split_book(rows).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == list(range(len(got)))
    assert all(20 < r.length <= 480 for r in got)
    joined = "".join(r.text for r in got)
    assert all(f"word{i}-{j}" in joined for i in range(60) for j in range(12)) and joined.count("x") >= 1200
    overlaps = [len(set(a.text.split("\n")) & set(b.text.split("\n"))) for a, b in zip(got, got[1:])]
    assert sum(overlaps) == 0  # single lines exceed the overlap, so no line repeats


def test_character_overlap(spark):
    rows = spark.createDataFrame([("book-1", "\n".join(f"line {i:03d} of forty characters, about.." for i in range(60)))],
                                 "book_uid string, text string")
    got = [r.text.split("\n") for r in chunking.split_book(rows).orderBy("chunk_id").collect()]
    assert all(a[-2:] == b[:2] for a, b in zip(got, got[1:]))


def test_one_evaluation_of_the_fold(spark):
    rows = spark.range(3).selectExpr("id as doc", "'A b. C' as text")
    out = chunking.exploded(chunking.window_chunks(rows, "text"), ["doc"], F.col("chunks"), "part", "c")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(") == 1 and plan.count("aggregate(") == 2  # one fold over segments, one within


def _split(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    return [r.c for r in rows.select("i", chunking.split_characters("text").alias("c")).orderBy("i").collect()]


def test_separators_stay_with_the_text_after_them(spark):
    text = "\n\n".join(["a" * 300, "\n" + "b" * 300, "c" * 100])
    assert _split(spark, [text]) == [["a" * 300, "b" * 300 + "\n\n" + "c" * 100]]


def _split_by_recursion(text, separators):
    """Chunks by the definition: pieces that are too long are split by finer separators, the others packed in order."""
    sep = separators[0]
    found = list(text) if not sep else text.split(sep)
    pieces = [p for p in ([found[0]] + [sep + p for p in found[1:]]) if p]
    chunks, held = [], []
    for piece in pieces:
        if len(piece) >= 480:
            chunks, held = [*chunks, "".join(held), *_split_by_recursion(piece, separators[1:])], []
        else:
            if sum(map(len, held)) + len(piece) > 480:
                chunks.append("".join(held))
                while sum(map(len, held)) > 100 or sum(map(len, held)) + len(piece) > 480:
                    held = held[1:]
            held.append(piece)
    return [c.strip() for c in [*chunks, "".join(held)] if c.strip()]


def test_character_split_against_recursion(spark):
    r = random.Random(3)
    texts = ["", " \n ", "a" * 479, "a" * 480, "a" * 481, "a" * 860, "a" * 861, " " * 900 + "q", "\U0001f600\xe9" * 700]
    for _ in range(120):
        words = []
        for _ in range(r.choice([10, 80, 600])):
            length = r.choice([1, 30, 100, 500, 1200]) if r.random() < 0.1 else r.randint(1, 9)
            words.append("".join(r.choices("ab\xe9\U0001f600.", k=length)) + r.choice([" ", " ", " ", ". ", "\n", "\n\n", "\n\n\n", "  "]))
        texts.append("".join(words))
    separators = ("\n\n", "\n", ". ", " ", "")
    assert _split(spark, [None, *texts]) == [[], *(_split_by_recursion(t, separators) for t in texts)]


def test_character_split_of_a_long_text(spark):
    sizes = spark.range(1).select(F.expr("repeat('x', 1000000)").alias("text")).repartition(1).select(
        F.size(chunking.split_characters("text")).alias("n"))
    assert sizes.first().n == 1 + -(-(1_000_000 - 480) // 380)
    assert "Python" not in sizes._jdf.queryExecution().executedPlan().toString()


def _merged_list(chunks):
    """The list walk over ``(pos, section, source, text, tokens)`` rows that the run merge must equal."""
    done, i = [], 0
    while i < len(chunks):
        pos, section, source, text, tok = chunks[i]
        i += 1
        if tok < 200 and done and done[-1][2] == source and done[-1][4] + tok <= 450:
            p, s, _, before, held = done.pop()
            done.append((p, s, source, before + "\n\n" + text, held + tok))
        elif tok < 200 and i < len(chunks) and chunks[i][2] == source and tok + chunks[i][4] <= 450:
            done.append((pos, section, source, text + "\n\n" + chunks[i][3], tok + chunks[i][4]))
            i += 1
        else:
            done.append((pos, section, source, text, tok))
    return done


@pytest.mark.parametrize("slice_rows", [65_536, 4])
def test_small_chunks_merge_over_rows_of_a_source(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(chunking, "RUN_SLICE", slice_rows)
    draw = random.Random(3)
    rows = []
    for q in range(4):
        place, site = 0, 0
        for _ in range(30):
            place += draw.choice([1, 1, 2, 9])
            site += draw.random() < 0.3
            words = draw.choice([20, 120, 190, 210, 260, 520])
            url = None if site == 2 else f"s{site % 3}"
            rows.append((q, place, url, 0.7, " ".join(f"w{n}" for n in range(words)) + "."))
    df = spark.createDataFrame(rows, "query_id int, pos int, url string, score double, content string")
    raw = chunking.chunk_results(df, merge=False).orderBy("query_id", "pos", "part").collect()
    want = []
    for q in range(4):
        listed = [(r.pos, r.section_index, r.source, r.chunk_text, r.token_estimate) for r in raw if r.query_id == q]
        want += [(q, *row) for row in _merged_list(listed)]
    got = chunking.chunk_results(df).orderBy("query_id", "pos", "part")
    found = [(r.query_id, r.pos, r.section_index, r.source, r.chunk_text, r.token_estimate) for r in got.collect()]
    assert found == want
    assert len(want) < len(raw)


def test_run_merge_of_an_empty_table(spark):
    none = spark.createDataFrame([], "query_id int, pos int, url string, score double, content string")
    assert chunking.chunk_results(none).collect() == []

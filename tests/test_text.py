from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions import scalars as sc
from ragspark.functions import text as tx
from ragspark.functions import vectors as vx
from ragspark.operators.requests import check_queries


def value(spark, expression, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return row.select(expression.alias("v")).first()["v"]


def of(spark, function, text):
    return value(spark, function(F.col("t")), t=text)


def test_keywords(spark):
    text = "Compare the differences between REST and GraphQL APIs"
    assert of(spark, tx.query_keywords, text) == ["differences", "rest", "graphql", "apis"]
    hits = tx.keyword_hits(F.col("t"), tx.query_keywords(F.col("q")))
    assert value(spark, hits, t="REST rest restful", q="rest") == 3


def test_pronouns(spark):
    assert of(spark, tx.pronoun_ratio, "You and we let our code run") == 4 / 7
    assert of(spark, tx.pronoun_ratio, "...") == 0.0


def test_structure(spark):
    assert of(spark, tx.has_structure, "a\n\nb")
    assert of(spark, tx.has_structure, "a\n  * b")
    assert of(spark, tx.has_structure, "a\nHeading Line\nb")
    assert not of(spark, tx.has_structure, "a\nheading line\nb - c")


def test_code_mixture(spark):
    assert not of(spark, tx.has_code_mixture, "def f():\nx = 1\ndone")
    assert of(spark, tx.has_code_mixture, "for all x\ny")
    assert not of(spark, tx.has_code_mixture, "forall x\ny")
    assert of(spark, tx.has_code_mixture, "if a then b: c\nd")
    assert not of(spark, tx.has_code_mixture, "if a\nd")
    assert not of(spark, tx.has_code_mixture, " \n")


def test_penalty(spark):
    assert len(fv.PENALTY_PHRASES) == 68
    assert len(fv.STOP_WORDS) == 31
    assert of(spark, tx.answer_penalty, "Which is better: A vs B?") == 1.0


def test_sentence_blocks(spark):
    assert of(spark, tx.sentence_blocks, "One. Two.\n\nThree") == ["One.", "Two.", "Three"]
    assert of(spark, tx.sentence_blocks, "One. two.\nÉt. \n Four") == ["One. two.\nÉt.", "Four"]


def test_clean_text(spark):
    assert of(spark, tx.clean_text, "A  b\t c \n\n\n d ,e\x07") == "A b c\nd,e"


def test_unicode_words(spark):
    text = "été à l'œuvre naïf x_1"
    assert of(spark, tx.token_estimate, text) == 6
    assert of(spark, tx.words, text) == ["été", "à", "l'œuvre", "naïf", "x_1"]
    assert of(spark, tx.collapse_whitespace, " 　 ") == "[EMPTY]"


def test_abstract(spark):
    inverted = F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(3)), F.lit("a"), F.array(F.lit(0), F.lit(2)))
    assert value(spark, tx.rebuild_abstract(inverted), x=1) == "a b a b"


def test_source_url(spark):
    url = sc.source_url(F.col("p"), F.col("d"), F.col("t"))
    assert value(spark, url, p="", d="10.1/a b", t="x") == "https://doi.org/10.1%2Fa+b"
    assert value(spark, url, p=" ", d=" ", t="a*b~c") == "https://scholar.google.com/scholar?q=a%2Ab~c"
    assert value(spark, url, p="", d="", t="") == ""


def test_confidence(spark):
    assert value(spark, sc.confidence(F.col("r"), F.col("s")), r=6.052, s=0.5876) == 3.866


def test_query_check(spark):
    rows = [(0, None), (1, "  "), (2, "ab"), (3, "x" * 501), (4, "!?!"), (5, " a <b> "), (6, "plain")]
    got = {r.query_id: r for r in check_queries(spark.createDataFrame(rows, "query_id int, query string")).collect()}
    assert [got[i].valid for i in range(7)] == [False] * 5 + [True, True]
    assert got[5].sanitized == "a <b>" and got[5].unusual and not got[6].unusual


def test_limits(spark):
    rows = spark.createDataFrame([("0",), ("7",), ("500",), ("x",), (None,)], "k string")
    assert [r[0] for r in rows.select(sc.book_top_k(F.col("k"))).collect()] == [5, 7, 100, 5, 5]


def test_vector_lengths_must_agree(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0))
    assert value(spark, vx.cosine(a, b), x=1) is None
    assert value(spark, vx.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), x=1) == 0.0


def test_inverted_words(spark):
    got = value(spark, tx.inverted_words(F.col("t")), t=["b a b", " a\tc "])
    assert {w: sorted(at) for w, at in got.items()} == {"a": [0, 1], "b": [0, 2], "c": [1]}
    assert value(spark, tx.rebuild_abstract(tx.inverted_words(F.array(F.col("t")))), t="b  a\nb c") == "b a b c"
    assert value(spark, tx.inverted_words(F.array(F.col("t"))), t=" \n") == {}


def test_rebuilt_abstracts_move_each_text_once(spark, small):
    from ragspark import registry
    registry.load()
    plan = registry.QUERIES["rebuilt_abstracts"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1

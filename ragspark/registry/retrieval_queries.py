"""Vector, ranking, BM25, near-duplicate, context and paper queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions import scalars as sc
from ragspark.functions import text as tx
from ragspark.functions import vectors as vx
from ragspark.operators import bm25, bm25_blocks, context, dedupe, papers, ranking, requests, vector_index, vectors
from ragspark.operators.embedding import hashing_embedder, precomputed
from ragspark.plans import passages
from ragspark.registry import query, tables
from ragspark.registry import sql as q
from ragspark.sources import files

NEAR = f"""near as (
  select * from (select p.query_id, p.book_uid, c.chunk_id, c.document, round({q.cosine('p.v', 'c.v')}, 9) as similarity,
    row_number() over (partition by p.query_id order by round({q.cosine('p.v', 'c.v')}, 9) desc, c.chunk_id)::INT as rank
  from passage_queries p join collections c using (book_uid)) where rank <= 5),
gated as (select * from (select *, max(similarity) over (partition by query_id) as best from near) where best >= 0.3)"""


@query("passage_top_k", f"with {q.PASSAGES}, {NEAR} select query_id, chunk_id, rank, round(similarity, 6) as similarity from near")
def _(spark, d):
    hits = vectors.nearest(tables.passage_queries(spark, d), tables.collections(spark, d), 5, scope=["book_uid"])
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("passage_top_k_blocks", f"with {q.PASSAGES}, {NEAR} select query_id, chunk_id, rank, round(similarity, 6) as similarity from near")
def _(spark, d):
    hits = vectors.nearest(tables.passage_queries(spark, d), tables.collections(spark, d), 5, scope=["book_uid"],
                           block_rows=256)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("gated_passages", f"""with {q.PASSAGES}, {NEAR}
select query_id, book_uid, chunk_id, rank, round(similarity, 4) as similarity_score from gated""")
def _(spark, d):
    hits = passages.best_passages(tables.passage_queries(spark, d), tables.collections(spark, d))
    return hits.select("query_id", "book_uid", "chunk_id", "rank", F.round("similarity", 4).alias("similarity_score"))


@query("passage_summary", f"""with {q.PASSAGES}, {NEAR}
select query_id, count(*) as total_results, round(max(similarity), 4) as top_similarity_score,
  0.3::DOUBLE as threshold_used, 'test-model' as model_used, round(max(similarity), 4) as confidence from gated group by 1""")
def _(spark, d):
    hits = passages.best_passages(tables.passage_queries(spark, d), tables.collections(spark, d))
    return requests.retrieval_summary(hits, "test-model")


@query("passage_context", f"""with {q.PASSAGES}, {NEAR}
select query_id, string_agg(document, chr(10) || chr(10) order by rank) as context from gated group by 1""")
def _(spark, d):
    hits = passages.best_passages(tables.passage_queries(spark, d), tables.collections(spark, d))
    return context.assemble_context(hits.join(tables.collections(spark, d).select("chunk_id", "document"), "chunk_id"))


@query("passage_outcomes", f"""with {q.PASSAGES}, {NEAR}, n as (select query_id, count(*) as n from gated group by 1)
select query_id, case when n is null then 'no_results' else 'ok' end as status, coalesce(n, 0) as total,
  case when n is null then 'No results found matching your query.' else 'Recommendations fetched successfully' end as message
from passage_queries left join n using (query_id)""")
def _(spark, d):
    asked = tables.passage_queries(spark, d)
    return requests.label_outcomes(asked, passages.best_passages(asked, tables.collections(spark, d)))


@query("squared_distance_top_k", f"""with {q.PASSAGES}, s as (
  select p.query_id, c.chunk_id, round(list_sum(list_transform(range(1, len(p.v) + 1),
    lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))), 9) as distance from passage_queries p join collections c using (book_uid))
select query_id, chunk_id, rank, round(distance, 6) as distance from (
  select *, row_number() over (partition by query_id order by distance, chunk_id)::INT as rank from s) where rank <= 20""")
def _(spark, d):
    hits = vectors.nearest(tables.passage_queries(spark, d), tables.collections(spark, d), 20, scope=["book_uid"],
                           metric="l2")
    return hits.withColumn("distance", F.round("distance", 6))


@query("approximate_passages")
def _(spark, d):
    return vectors.nearest_approximate(
        tables.passage_queries(spark, d), tables.collections(spark, d), 5, 64, scope=["book_uid"])


@query("passage_index_recall", f"""with {q.PASSAGES},
s as (select query_id, chunk_id, round({q.cosine('p.v', 'c.v')}, 9) as similarity from passage_queries p cross join collections c),
near as (select *, row_number() over (partition by query_id order by similarity desc, chunk_id) as rank from s)
select count(distinct query_id) as queries, count(*) as neighbours, round(sum(similarity), 2) as similarity,
  true as recall_reached, true as few_compared from near where rank <= 5""")
def _(spark, d):
    """Of the five nearest of all passages the index must find 0.9, comparing less than a tenth of them exactly."""
    asked = tables.passage_queries(spark, d)
    chunks = tables.collections(spark, d)
    report = vector_index.recall_report(asked, chunks, vector_index.build_index(chunks, 64), 5)
    return report.select("queries", "neighbours", F.round("similarity", 2).alias("similarity"),
                         (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("share_exact") < 0.1).alias("few_compared"))


@query("similar_vector_pairs", f"""with {q.PASSAGES}
select a.chunk_id as left_id, b.chunk_id as right_id, round({q.cosine('a.v', 'b.v')}, 6) as similarity
from collections a join collections b on a.book_uid = b.book_uid and a.chunk_id < b.chunk_id
where round({q.cosine('a.v', 'b.v')}, 9) > 0.35""")
def _(spark, d):
    pairs = vectors.similar_pairs(tables.collections(spark, d), 0.35, scope=["book_uid"], key="chunk_id")
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("near_duplicate_prune", f"""with recursive {q.PASSAGES},
placed as (select *, row_number() over (partition by book_uid order by chunk_id) as n from collections),
close as (select b.book_uid, b.n, list(a.chunk_id) as earlier from placed a join placed b
  on a.book_uid = b.book_uid and a.n < b.n where round({q.cosine('a.v', 'b.v')}, 9) > 0.25 group by all),
walk as (
  select distinct book_uid, 0::BIGINT as n, []::BIGINT[] as kept from placed union all
  select w.book_uid, p.n, case when list_has_any(w.kept, coalesce(c.earlier, []::BIGINT[])) then w.kept
                               else list_append(w.kept, p.chunk_id) end
  from walk w join placed p on p.book_uid = w.book_uid and p.n = w.n + 1
  left join close c on c.book_uid = p.book_uid and c.n = p.n)
select book_uid, unnest(kept) as chunk_id from walk w
where n = (select max(n) from placed p where p.book_uid = w.book_uid)""")
def _(spark, d):
    kept = dedupe.prune_near_duplicates(
        tables.collections(spark, d), [F.col("chunk_id")], key="chunk_id", scope="book_uid", threshold=0.25)
    return kept.select("book_uid", "chunk_id")


@query("unit_vectors", """select vec_id, i - 1 as slot, round(v[i] * 3 / sqrt(list_dot_product(v, v) * 9), 5) as value
from (select vec_id, embedding::DOUBLE[] as v from embeddings), range(1, 65) r(i)""")
def _(spark, d):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    rows = tables.table(spark, d, "embeddings").select("vec_id", F.posexplode(vx.unit(tripled)).alias("slot", "value"))
    return rows.select("vec_id", F.col("slot").cast("bigint").alias("slot"), F.round("value", 5).alias("value"))


@query("vector_scores", f"""with v as (select vec_id, label, embedding::DOUBLE[] as a, list_reverse(embedding)::DOUBLE[] as b from embeddings)
select vec_id, round({q.cosine('a', 'b')}, 6) as cosine, round(list_dot_product(a, b), 6) as dot,
  round(list_dot_product(a, a) + list_dot_product(b, b) - 2 * list_dot_product(a, b), 6) as squared_l2 from v""")
def _(spark, d):
    a, b = F.col("embedding"), F.reverse("embedding")
    return tables.table(spark, d, "embeddings").select(
        "vec_id", F.round(vx.cosine(a, b), 6).alias("cosine"), F.round(vx.dot(a, b), 6).alias("dot"),
        F.round(vx.squared_l2(a, b), 6).alias("squared_l2"))


@query("embedding_report", """with n as (select 'book-' || label as book_uid, len(embedding)::INT as dim,
  sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) as norm from embeddings)
select book_uid, count(*) as total_embeddings, min(dim) as min_dim, max(dim) as max_dim, round(min(norm), 5) as min_norm,
  round(max(norm), 5) as max_norm, bool_and(abs(norm - 1) <= 1e-5 + 1e-8) as all_normalized from n group by 1""")
def _(spark, d):
    return vectors.embedding_report(tables.collections(spark, d), ["book_uid"])


@query("dimension_check", """select vec_id as query_id, 'book-' || (label + case when label > 7 then 90 else 0 end) as book_uid,
  case when label > 7 then 'embeddings_missing' when label < 3 then 'chroma_embedding_dimension_mismatch' else 'ok' end as status,
  case when label < 3 then 128 else 64 end as query_dim, case when label > 7 then null else 64 end as collection_dim from embeddings""")
def _(spark, d):
    label = F.col("label")
    asked = tables.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("book-"), (label + F.when(label > 7, 90).otherwise(0)).cast("string")).alias("book_uid"),
        F.when(label < 3, F.concat("embedding", "embedding")).otherwise(F.col("embedding")).alias("embedding"))
    return vectors.dimension_check(asked, tables.collections(spark, d), "book_uid")


@query("hashed_embeddings", f"""with texts as (select item_id, text from benchmark), _slots_item_id as ({q.slots('texts', 'item_id', 'text')}),
h as ({q.hashed('texts', 'item_id', 'text')})
select item_id, i - 1 as slot, round(v[i], 5) as value from h, range(1, 65) r(i)""")
def _(spark, d):
    embedded = hashing_embedder()(tables.table(spark, d, "benchmark"), "text", "v")
    rows = embedded.select("item_id", F.posexplode("v").alias("slot", "value"))
    return rows.select("item_id", F.col("slot").cast("bigint").alias("slot"),
                       F.round(F.col("value").cast("double"), 5).alias("value"))


@query("precomputed_embeddings", "select vec_id, len(embedding)::INT as dim from embeddings")
def _(spark, d):
    embedded = precomputed("embedding")(tables.table(spark, d, "embeddings"), "vec_id", "v")
    return embedded.select("vec_id", F.size("v").alias("dim"))


@query("similarity_threshold", f"""with {q.WEB} select doc_id, query_id, round(score + 0.00004::DOUBLE, 4) as similarity from web
where score + 0.00004::DOUBLE >= 0.35""")
def _(spark, d):
    rows = tables.web_results(spark, d).select("doc_id", "query_id", (F.col("score") + 0.00004).alias("similarity"))
    return ranking.similar_enough(rows, 0.35)


@query("similarity_order", f"""with {q.WEB} select query_id, pos, score as similarity from web order by query_id, score desc, pos""")
def _(spark, d):
    return ranking.by_similarity(tables.web_results(spark, d).select("query_id", "pos", F.col("score").alias("similarity")))


@query("score_top_k", f"""with {q.WEB} select * from (select query_id, pos, score,
  row_number() over (partition by query_id order by score desc, pos)::INT as rank from web) where rank <= 6""")
def _(spark, d):
    rows = tables.web_results(spark, d).select("query_id", "pos", "score")
    return ranking.top_k(rows, ["query_id"], [F.desc("score"), F.asc("pos")], 6)


@query("token_budget", f"""with {q.CONTEXT_CHUNKS} select query_id, rank, token_estimate from (
  select *, sum(token_estimate) over (partition by query_id order by rerank_score desc, rank) as used from chunks) where used <= 900""")
def _(spark, d):
    kept = ranking.token_budget(tables.context_chunks(spark, d), [-F.col("rerank_score"), F.col("rank")])
    return kept.select("query_id", "rank", "token_estimate")


@query("compression_decision", f"with {q.CONTEXT_CHUNKS}, {q.DECISION} select * from decision")
def _(spark, d):
    return context.compression_decision(tables.context_chunks(spark, d))


@query("low_rerank_filter", f"""with {q.CONTEXT_CHUNKS},
lowered as (select query_id, rank, rerank_score - query_id % 3 * 4 as score from chunks), good as (select * from lowered where score >= 4.5)
select query_id, rank from good union all
select query_id, rank from lowered where query_id not in (select query_id from good)""")
def _(spark, d):
    lowered = F.col("rerank_score") - F.col("query_id") % 3 * 4
    rows = tables.context_chunks(spark, d).withColumn("rerank_score", lowered)
    return context.drop_low_rerank(rows).select("query_id", "rank")


@query("final_context", f"with {q.CONTEXT_CHUNKS}, {q.FINAL_CONTEXT} select * from final_context")
def _(spark, d):
    return context.final_context(tables.context_chunks(spark, d))


@query("web_prompts_md5", f"""with {q.CONTEXT_CHUNKS}, {q.FINAL_CONTEXT},
c as (select query_id, string_agg('Source ' || block || ': ' || text, chr(10) || chr(10) order by block) as context
      from final_context group by 1)
select query_id, md5(replace(replace({q.quoted([fv.WEB_PROMPT])}, '{{query}}', query), '{{context}}', coalesce(context, ''))) as prompt
from queries left join c using (query_id)""")
def _(spark, d):
    blocks = context.final_context(tables.context_chunks(spark, d))
    return context.web_prompt(tables.queries(spark, d), blocks).withColumn("prompt", F.md5("prompt"))


@query("passage_prompts_md5", f"""with {q.PASSAGES}, {NEAR},
c as (select query_id, string_agg(document, chr(10) || chr(10) order by rank) as context from gated group by 1)
select query_id, md5(replace(replace({q.quoted([fv.PASSAGE_PROMPT])}, '{{query}}', 'question ' || query_id), '{{context}}',
  coalesce(context, ''))) as prompt from passage_queries left join c using (query_id)""")
def _(spark, d):
    asked = tables.passage_queries(spark, d)
    hits = passages.best_passages(asked, tables.collections(spark, d))
    named = asked.withColumn("query", F.concat(F.lit("question "), F.col("query_id").cast("string")))
    full = hits.join(tables.collections(spark, d).select("chunk_id", "document"), "chunk_id")
    return context.passage_prompt(named, full).withColumn("prompt", F.md5("prompt"))


BM25 = f"{q.QUERIES}, {q.bm25('documents', 'doc_id', 'text', 'queries', 20)}"


@query("bm25_terms", f"with {BM25} select term, df, round(idf, 6) as idf from bm25_terms")
def _(spark, d):
    docs = tables.table(spark, d, "documents")
    rows = bm25.term_statistics(bm25.postings(docs), docs.count())
    return rows.select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_corpus_numbers", f"with {BM25} select n::BIGINT as documents, round(mean_length, 6) as mean_length from bm25_numbers")
def _(spark, d):
    row = bm25.corpus_numbers(tables.table(spark, d, "documents"))
    return row.select("documents", F.round("mean_length", 6).alias("mean_length"))


@query("bm25_postings", f"with {BM25} select doc_id, term, tf::INT as tf from bm25_tf")
def _(spark, d):
    return bm25.postings(tables.table(spark, d, "documents")).select("doc_id", "term", "tf")


@query("bm25_top_k", f"with {BM25} select query_id, doc_id, round(score, 5) as score, rank from bm25_hits")
def _(spark, d):
    hits = bm25.search(tables.queries(spark, d), bm25.build_index(tables.table(spark, d, "documents")), 20)
    return hits.withColumn("score", F.round("score", 5))


SHORT = f"""queries as (select n_nationkey as query_id, n_name || ' 17' as query from nation),
lines as (select p_partkey as doc_id, p_type || ' ' || p_name as text from part), {q.bm25('lines', 'doc_id', 'text', 'queries', 30, full=True)}"""
HALF = f"""queries as (select r_regionkey as query_id, case when r_regionkey % 2 = 0 then 'even' else 'odd rare' || r_regionkey end as query from region),
lines as (select s_suppkey as doc_id, (case when s_suppkey % 2 = 0 then 'even ' else 'odd ' end) || 'w' || s_suppkey || ' v' || s_suppkey as text
          from supplier), {q.bm25('lines', 'doc_id', 'text', 'queries', 60, full=True)}"""


@query("bm25_block_top_k", f"with {BM25} select query_id, doc_id, round(score, 5) as score, rank from bm25_hits")
def _(spark, d):
    index = bm25_blocks.block_index(bm25.build_index(tables.table(spark, d, "documents")), block_postings=20_000)
    return bm25_blocks.search(tables.queries(spark, d), index, 20).withColumn("score", F.round("score", 5))


@query("bm25_full_ranking", f"""with {q.QUERIES},
{q.bm25('documents', 'doc_id', 'text', 'queries', 20, full=True)} select query_id, doc_id, round(score, 5) as score, rank from bm25_hits""")
def _(spark, d):
    docs = tables.table(spark, d, "documents")
    hits = bm25.search_filled(tables.queries(spark, d), docs, bm25.build_index(docs), 20)
    return hits.withColumn("score", F.round("score", 5))


@query("bm25_short_queries", f"with {SHORT} select query_id, doc_id, round(score, 5) as score, rank from bm25_hits")
def _(spark, d):
    asked = tables.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("query_id"), F.concat("n_name", F.lit(" 17")).alias("query"))
    docs = tables.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_type", "p_name").alias("text"))
    return bm25.search_filled(asked, docs, bm25.build_index(docs), 30).withColumn("score", F.round("score", 5))


@query("bm25_zero_weights", f"with {HALF} select query_id, doc_id, round(score, 5) as score, rank from bm25_hits")
def _(spark, d):
    even = F.col("r_regionkey") % 2 == 0
    asked = tables.table(spark, d, "region").select(
        F.col("r_regionkey").alias("query_id"),
        F.when(even, "even").otherwise(F.concat(F.lit("odd rare"), F.col("r_regionkey").cast("string"))).alias("query"))
    key = F.col("s_suppkey")
    docs = tables.table(spark, d, "supplier").select(key.alias("doc_id"), F.concat(
        F.when(key % 2 == 0, "even ").otherwise("odd "), F.lit("w"), key.cast("string"), F.lit(" v"), key.cast("string")).alias("text"))
    return bm25.search_filled(asked, docs, bm25.build_index(docs), 60).withColumn("score", F.round("score", 5))


@query("lexical_rerank_scores", f"with {q.WEB} select doc_id, round({q.lexical('query', 'content')} - {q.penalty('content')}, 4) as rerank_score from web")
def _(spark, d):
    from ragspark.operators.embedding import lexical_scorer
    score = lexical_scorer(F.col("query"), F.col("content")) - tx.answer_penalty(F.col("content"))
    return tables.web_results(spark, d).select("doc_id", F.round(score, 4).alias("rerank_score"))


@query("first_seen_titles", f"""with {q.PAPERS} select query_id, title, min(pos) as pos from candidates_ group by all""")
def _(spark, d):
    return papers.dedupe_titles(tables.candidate_papers(spark, d)).select("query_id", "title", "pos")


@query("open_access_papers", f"with {q.PAPERS} select paper_id from papers where is_oa")
def _(spark, d):
    return papers.access_filter(tables.papers(spark, d), "open_access").select("paper_id")


@query("subscription_papers", f"""with {q.PAPERS}, c as (select *, query_id % 7 as g from candidates_),
p as (select * replace (case when g = 3 then 'MIT Press' else publisher end as publisher) from c),
k as (select * from p where regexp_matches(lower(publisher), 'ieee|electrical and electronics engineers|elsevier|springer'))
select query_id, paper_id from k union all
select query_id, paper_id from p where not is_oa and query_id not in (select query_id from k)""")
def _(spark, d):
    rows = tables.candidate_papers(spark, d).withColumn(
        "publisher", F.when(F.col("query_id") % 7 == 3, "MIT Press").otherwise(F.col("publisher")))
    return papers.access_filter(rows, "subscription").select("query_id", "paper_id")


@query("cited_papers_top_k", f"""with {q.PAPERS} select query_id, paper_id, citations, rank from (select *,
  row_number() over (partition by query_id order by citations desc, pos)::INT as rank from candidates_) where rank <= 20""")
def _(spark, d):
    rows = tables.candidate_papers(spark, d)
    best = ranking.top_k(rows, ["query_id"], [F.desc("citations"), F.asc("pos")], 20)
    return best.select("query_id", "paper_id", "citations", "rank")


@query("relative_scores", f"""with {q.PAPERS}, t as (select * from (select *,
  row_number() over (partition by query_id order by citations desc, pos)::INT as rank from candidates_) where rank <= 5)
select query_id, rank, round(s, 4) as similarity_score, round(s * 100, 2) as match_percentage from (
  select *, coalesce(citations::DOUBLE / nullif(max(citations) over (partition by query_id), 0), 0.0) as s from t)""")
def _(spark, d):
    rows = tables.candidate_papers(spark, d)
    best = ranking.top_k(rows, ["query_id"], [F.desc("citations"), F.asc("pos")], 5)
    return ranking.relative_score(best, "citations").select("query_id", "rank", "similarity_score", "match_percentage")


@query("source_fallback", f"""with {q.PAPERS}, a as (select * from candidates_ where query_id in
  (select item_id from benchmark where length(text) > 200)), b as (select * from candidates_)
select query_id, paper_id, 'first' as source from a union all
select query_id, paper_id, 'second' from b where query_id not in (select query_id from a)""")
def _(spark, d):
    rows = tables.candidate_papers(spark, d)
    longer = tables.queries(spark, d).where(F.length("query") > 200)
    first = rows.join(longer, "query_id", "left_semi").withColumn("source", F.lit("first"))
    both = papers.with_source_fallback(first, rows.withColumn("source", F.lit("second")))
    return both.select("query_id", "paper_id", "source")


@query("graph_source_papers", f"""with {q.PAPERS} select paper_id, title, doi, year, abstract, case when year > 2000 then citations else 0 end as citations,
  coalesce(nullif(publisher, ''), '') as publisher, pdf is not null as is_oa, pdf from papers""")
def _(spark, d):
    rows = tables.papers(spark, d).select(
        "paper_id", "title", F.col("doi").alias("paperId"), "year", "abstract", F.nullif("publisher", F.lit("")).alias("venue"),
        F.when(F.col("year") > 2000, F.col("citations")).alias("citationCount"),
        F.when(F.col("pdf").isNotNull(), F.struct(F.col("pdf").alias("url"))).alias("openAccessPdf"))
    return papers.from_graph_source(rows, "paper_id")


@query("works_source_papers", f"""with {q.PAPERS} select paper_id, title, doi, year, array_to_string({q.words('title')}, ' ') as abstract,
  citations, publisher, case when paper_id % 2 = 0 then is_oa else false end as is_oa,
  case when paper_id % 2 = 0 then pdf end as pdf from papers""")
def _(spark, d):
    rows = tables.papers(spark, d)
    places = rows.select("paper_id", F.posexplode(tx.words(F.col("title"))).alias("at", "word"))
    lists = places.groupBy("paper_id", "word").agg(F.collect_list("at").alias("ats"))
    inverted = lists.groupBy("paper_id").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "ats"))).alias("abstract_inverted_index"))
    access = F.struct(F.col("is_oa"), F.col("pdf").alias("oa_url"))
    raw = rows.join(inverted, "paper_id", "left").select(
        "paper_id", "title", F.col("doi").alias("id"), F.col("year").alias("publication_year"),
        F.col("citations").alias("cited_by_count"), "abstract_inverted_index",
        F.when(F.col("publisher") != "", F.struct("publisher")).alias("host_venue"),
        F.when(F.col("paper_id") % 2 == 0, access).alias("open_access"))
    return papers.from_works_source(raw, "paper_id")


@query("clean_paper_metadata", f"""with {q.PAPERS} select paper_id, title, coalesce(doi, '') as doi,
  case when paper_id % 3 = 1 then 0 else year end as year, case when paper_id % 5 = 2 then 0 else citations end as citations,
  coalesce(pdf, '') as pdf, paper_id % 3 = 0 as is_oa from papers""")
def _(spark, d):
    i = F.col("paper_id")
    rows = tables.papers(spark, d).withColumns({
        "year": F.when(i % 3 == 1, F.lit("n/a")).otherwise(F.col("year").cast("string")),
        "citations": F.when(i % 5 != 2, F.col("citations")),
        "is_oa": F.when(i % 3 == 0, F.lit("true"))})
    return papers.clean_metadata(rows).select("paper_id", "title", "doi", "year", "citations", "pdf", "is_oa")


@query("paper_links", rf"""with {q.PAPERS}, e as (select *, nullif({q.strip("coalesce(doi, '')")}, '') as ident, nullif({q.strip('title')}, '') as name from papers)
select paper_id, case when pdf is not null then pdf when regexp_matches(ident, '^https?://') then ident
  when starts_with(ident, '10.') then 'https://doi.org/' || replace(url_encode(ident), '%20', '+')
  when ident is not null then 'https://www.semanticscholar.org/paper/' || replace(url_encode(ident), '%20', '+')
  when name is not null then 'https://scholar.google.com/scholar?q=' || replace(url_encode(name), '%20', '+') else '' end as source_url,
  case when length(abstract) > 320 then substr(abstract, 1, 320) || '...' else abstract end as summary from e""")
def _(spark, d):
    return tables.papers(spark, d).select(
        "paper_id", sc.source_url(F.col("pdf"), F.col("doi"), F.col("title")).alias("source_url"),
        tx.summary(F.col("abstract")).alias("summary"))


HYBRID = f"""{q.QUERIES}, {q.PAPERS}, corpus as (select *, title || ' ' || abstract as text from papers),
_slots_paper_id as ({q.slots('corpus', 'paper_id', 'text')}), paper_vectors as ({q.hashed('corpus', 'paper_id', 'text')}),
_slots_query_id as ({q.slots('queries', 'query_id', 'query')}), query_vectors as ({q.hashed('queries', 'query_id', 'query')}),
vector_hits as (select * from (select a.query_id, b.paper_id, row_number() over (partition by a.query_id order by
    round(list_dot_product(a.v::FLOAT[]::DOUBLE[], a.v::FLOAT[]::DOUBLE[]) + list_dot_product(b.v::FLOAT[]::DOUBLE[], b.v::FLOAT[]::DOUBLE[])
          - 2 * list_dot_product(a.v::FLOAT[]::DOUBLE[], b.v::FLOAT[]::DOUBLE[]), 9), b.paper_id) as rank
  from query_vectors a, paper_vectors b) where rank <= 20),
{q.bm25('corpus', 'paper_id', 'text', 'queries', 20, full=True)},
united as (select query_id, paper_id, 0 as branch, rank as place from vector_hits union all
           select query_id, paper_id, 1, rank from bm25_hits),
once as (select * from (select u.*, p.* exclude (paper_id), row_number() over (partition by query_id, title order by branch, place) as seen
         from united u join papers p using (paper_id)) where seen = 1),
hybrid as (select *, row_number() over (partition by query_id order by citations desc, branch, place)::INT as rank from once
           qualify rank <= 20)"""


def _paper_index(spark, d):
    return hashing_embedder()(papers.paper_text(tables.papers(spark, d)), "text", "embedding")


@query("hybrid_papers", f"with {HYBRID} select query_id, paper_id, citations, branch, place::INT as place, rank from hybrid")
def _(spark, d):
    index_table = _paper_index(spark, d)
    asked = hashing_embedder()(tables.queries(spark, d), "query", "embedding")
    found = papers.hybrid_search(asked, index_table, bm25.build_index(index_table, "paper_id"))
    return found.select("query_id", "paper_id", "citations", "branch", "place", "rank")


@query("priority_union", f"with {HYBRID} select query_id, paper_id, branch, place::INT as place from once")
def _(spark, d):
    index_table = _paper_index(spark, d)
    asked = hashing_embedder()(tables.queries(spark, d), "query", "embedding")
    near = vectors.nearest(asked, index_table, 20, corpus_key="paper_id", metric="l2")
    found = bm25.search_filled(asked, index_table, bm25.build_index(index_table, "paper_id"), 20, key="paper_id")
    merged = papers.merge_hits(near, found, index_table.select("paper_id", *papers.PAPER), 40)
    return merged.select("query_id", "paper_id", "branch", "place")


@query("plain_paper_ranking", f"""with {q.PAPERS}, o as (select query_id, title, min(pos) as pos from candidates_ group by all)
select query_id, pos, rank from (select *, row_number() over (partition by query_id order by pos)::INT as rank from o) where rank <= 20""")
def _(spark, d):
    return papers.plain_ranking(tables.candidate_papers(spark, d)).select("query_id", "pos", "rank")


@query("collections_in_order", """select 'book-' || label as book_uid from embeddings group by label order by label""")
def _(spark, d):
    return files.natural_order(tables.collections(spark, d))

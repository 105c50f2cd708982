"""Whole flows."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions import text as tx
from ragspark.operators import papers, quality, requests
from ragspark.operators.embedding import hashing_embedder, lexical_scorer
from ragspark.operators.rerank import rerank
from ragspark.plans import books, journals, passages, web
from ragspark.plans.staged import run_stages
from ragspark.registry import query, tables
from ragspark.registry import sql as q
from ragspark.registry.retrieval_queries import HYBRID, NEAR
from ragspark.registry.text_queries import ACTIVE, BOOK_CHUNKS, CHUNK_SQL, scans
from ragspark.session import shared_folder
from ragspark.sources import files
from ragspark.sources.tables import insert_if_absent, stored, write_collections
from ragspark.streaming import incremental

SCORED = f"""{q.FILTERED}, source_texts as (select query_id * 1000000 + pos as doc, content from filtered), {CHUNK_SQL},
parts as (select f.query_id, f.pos::BIGINT * 1048576 + m.part as chunk_key, f.url as source, m.chunk_text, m.token_estimate,
                 f.query_id * 10000000000000 + f.pos::BIGINT * 1048576 + m.part as part_id
          from merged_chunks m join filtered f on m.doc = f.query_id * 1000000 + f.pos),
_slots_part_id as ({q.slots('parts', 'part_id', 'chunk_text')}), part_vectors as ({q.hashed('parts', 'part_id', 'chunk_text')}),
_slots_query_id as ({q.slots('queries', 'query_id', 'query')}), query_vectors as ({q.hashed('queries', 'query_id', 'query')}),
measured as (select p.*, v.v::FLOAT[]::DOUBLE[] as v, round({q.cosine('v.v::FLOAT[]::DOUBLE[]', 'a.v::FLOAT[]::DOUBLE[]')}, 9) as raw
             from parts p join part_vectors v using (part_id) join query_vectors a using (query_id)),
scored as (select * exclude (raw), round(raw, 4) as similarity from measured where raw >= 0.35)"""

CONTEXT = f"""{SCORED},
placed as (select *, row_number() over (partition by query_id order by similarity desc, chunk_key) as n from scored),
close as (select b.query_id, b.n, list(a.chunk_key) as earlier from placed a join placed b on a.query_id = b.query_id and a.n < b.n
          where round({q.cosine('a.v', 'b.v')}, 9) > 0.9 group by all),
prune_walk as (
  select distinct query_id, 0::BIGINT as n, []::BIGINT[] as kept_keys from placed union all
  select w.query_id, p.n, case when list_has_any(w.kept_keys, coalesce(c.earlier, []::BIGINT[])) then w.kept_keys
                               else list_append(w.kept_keys, p.chunk_key) end
  from prune_walk w join placed p on p.query_id = w.query_id and p.n = w.n + 1
  left join close c on c.query_id = p.query_id and c.n = p.n),
pruned as (select query_id, unnest(kept_keys) as chunk_key from prune_walk w
           where n = (select max(n) from placed p where p.query_id = w.query_id)),
ranked as (select * from (select s.query_id, s.chunk_key, s.source, s.chunk_text, s.token_estimate, s.similarity, r.rerank_score,
             row_number() over (partition by s.query_id order by r.rerank_score desc, s.similarity desc, s.chunk_key)::INT as rank
           from pruned join scored s using (query_id, chunk_key) join (
             select query_id, chunk_key, round({q.lexical('query', 'chunk_text')} - {q.penalty('chunk_text')}, 4) as rerank_score
             from scored join queries using (query_id)) r using (query_id, chunk_key)) where rank <= 6),
flags as (select *, {q.forum_source('source')} as is_forum, {q.noise('chunk_text')} as is_noise,
                 {q.code_share('chunk_text')} >= 0.35 as is_code from ranked),
{q.FINAL_CONTEXT}"""


def _short_key():
    """The key with a result's place counted in steps of 2^20, as the SQL statements write it."""
    pos = F.floor(F.col("chunk_key") / web.PARTS_PER_RESULT)
    return (pos * 1048576 + F.col("chunk_key") % web.PARTS_PER_RESULT).alias("chunk_key")


@query("chunk_similarity",f"with recursive {SCORED} select query_id, chunk_key, token_estimate, round(similarity, 4) as similarity from scored")
def _(spark, d):
    results = tables.web_results(spark, d)
    filtered = quality.filter_with_fallback(results)
    scored = web.scored_chunks(filtered, web.query_table(results), hashing_embedder(), 0.35)
    return scored.select("query_id", _short_key(), "token_estimate", "similarity")


@query("reranked_chunks", f"with recursive {CONTEXT} select query_id, chunk_key, rerank_score, rank from ranked")
def _(spark, d):
    results = tables.web_results(spark, d)
    asked = web.query_table(results)
    scored = web.scored_chunks(quality.filter_with_fallback(results), asked, hashing_embedder(), 0.35)
    return rerank(web.pruned_chunks(scored), asked, lexical_scorer).select("query_id", _short_key(), "rerank_score", "rank")


@query("web_context", f"with recursive {CONTEXT} select * from final_context")
def _(spark, d):
    return web.web_context(tables.web_results(spark, d))


def _requests(spark, d):
    """Every vector's request: its text, and its book - or none, or an unknown one."""
    i = F.col("vec_id")
    return tables.table(spark, d, "embeddings").select(
        i.alias("query_id"),
        F.when(i % 10 == 0, " ").otherwise(F.concat(F.lit("question "), i.cast("string"))).alias("query"),
        F.when(i % 10 == 1, "").when(i % 10 == 2, "book-99")
        .otherwise(F.concat(F.lit("book-"), F.col("label").cast("string"))).alias("book"))


def _vector_of_request(spark, d):
    vectors = tables.passage_queries(spark, d).select(F.col("query_id"), F.col("embedding").alias("_v"))

    def embed(df, text, out="embedding"):
        return df.join(vectors.select("query_id", F.col("_v").alias(out)), "query_id")
    return embed


@query("passage_answers", f"""with {q.PASSAGES}, asked as (
  select vec_id as query_id, case when vec_id % 10 <> 0 then 'question ' || vec_id end as query,
    case vec_id % 10 when 1 then null when 2 then 'book-99' else 'book-' || label end as book from embeddings),
n as (
  select query_id, count(*) as n, round(max(similarity), 4) as top from (
    select p.query_id, {q.cosine('p.v', 'c.v')} as similarity,
      row_number() over (partition by p.query_id order by {q.cosine('p.v', 'c.v')} desc, c.chunk_id) as rank
    from asked a join passage_queries p using (query_id) join collections c on c.book_uid = a.book where a.query is not null)
  where rank <= 5 group by 1 having max(similarity) >= 0.3)
select query_id, book as book_uid, case when n is null then 'error' else 'success' end as status,
  case when query is null then 'malformed input: query_text must be a non-empty string'
       when book is null then 'missing book selection' when book = 'book-99' then 'missing embeddings for book ''book-99'''
       when n is null then 'no sufficiently relevant content found' end as error,
  coalesce(top, 0.0) as confidence, coalesce(n, 0) as total_results, coalesce(n_name, 'Unknown Title') as book_title
from asked left join n using (query_id) left join nation on book = 'book-' || n_nationkey""")
def _(spark, d):
    titles = tables.table(spark, d, "nation").select(
        F.concat(F.lit("book-"), F.col("n_nationkey").cast("string")).alias("book_uid"), F.col("n_name").alias("title"))
    outcome, _records = passages.retrieve(
        _requests(spark, d), tables.collections(spark, d), titles, _vector_of_request(spark, d), "test-model",
        F.expr("timestamp'2026-01-02 03:04:05'"))
    return outcome


@query("passage_records", f"""with {q.PASSAGES}, {NEAR} select query_id, 'question ' || query_id as query, any_value(book_uid) as book,
  count(*)::INT as listed, arg_min(chunk_id, rank) as first_chunk, round(max(similarity), 4) as top_similarity_score
from gated where query_id % 10 not in (0, 1, 2) group by query_id""")
def _(spark, d):
    titles = tables.table(spark, d, "nation").select(
        F.concat(F.lit("book-"), F.col("n_nationkey").cast("string")).alias("book_uid"), F.col("n_name").alias("title"))
    _outcome, records = passages.retrieve(
        _requests(spark, d), tables.collections(spark, d), titles, _vector_of_request(spark, d), "test-model",
        F.expr("timestamp'2026-01-02 03:04:05'"))
    return records.select("query_id", "query", "book", F.size("results").alias("listed"),
                          F.get("results", F.lit(0))["chunk_id"].alias("first_chunk"), "summary.top_similarity_score")


@query("book_index", f"""with {BOOK_CHUNKS},
passages as (select doc || '/' || chunk_id as passage, doc, chunk_id, text as document from split_chunks),
_slots_passage as ({q.slots('passages', 'passage', 'document')}),
h as ({q.hashed('passages', 'passage', 'document')})
select p.doc as book_uid, p.chunk_id, p.document, array_to_string(list_transform(h.v,
  lambda x: floor(coalesce(x, 0)::FLOAT::DOUBLE * 1000000)::BIGINT), ',') as millionths
from passages p join h on h.passage = p.passage""")
def _(spark, d):
    docs = tables.table(spark, d, "documents").select(
        F.concat(F.lit("book-"), F.col("doc_id").cast("string")).alias("book_uid"), "text")
    millionths = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000000).cast("string"))
    return passages.book_vectors(docs, hashing_embedder()).select(
        "book_uid", "chunk_id", "document", F.array_join(millionths, ",").alias("millionths"))


BOOK_HITS = f"""asked as (select vec_id as query_id, 'wish ' || vec_id || case when vec_id % 9 = 0 then repeat('.', 600) else '' end as query,
    case when vec_id % 4 = 0 then 0 else vec_id % 8 end as top_k, list_reverse(embedding)::DOUBLE[] as v from embeddings),
shelf as (select vec_id as book_id, embedding::DOUBLE[] as v, 'title ' || vec_id as title, case when label > 3 then 'author ' || label end as author,
    'label ' || label as category, 'summary ' || vec_id as summary from embeddings),
nearest as (select * from (select a.query_id, a.top_k, b.*, round({q.cosine('a.v', 'b.v')}, 9) as s,
    row_number() over (partition by a.query_id order by round({q.cosine('a.v', 'b.v')}, 9) desc, b.book_id) as place
  from asked a, shelf b where length(a.query) <= 500) where place <= case when top_k < 1 then 5 else top_k end and s >= 0.3)"""


def _book_flow(spark, d):
    rows = tables.table(spark, d, "embeddings")
    i = F.col("vec_id")
    asked = rows.select(
        i.alias("query_id"),
        F.concat(F.lit("wish "), i.cast("string"), F.when(i % 9 == 0, F.repeat(F.lit("."), F.lit(600))).otherwise("")).alias("query"),
        F.when(i % 4 == 0, 0).otherwise((i % 8).cast("int")).alias("top_k"),
        F.reverse("embedding").alias("embedding"))
    label = F.col("label").cast("string")
    shelf = rows.select(
        i.alias("book_id"), "embedding", F.concat(F.lit("title "), i.cast("string")).alias("title"),
        F.when(F.col("label") > 3, F.concat(F.lit("author "), label)).alias("author"),
        F.concat(F.lit("label "), label).alias("category"), F.concat(F.lit("summary "), i.cast("string")).alias("summary"))
    return asked, books.recommend_by_vector(asked, shelf)


@query("book_recommendation", f"""with {BOOK_HITS}
select query_id, row_number() over (partition by query_id order by s desc, book_id)::INT as rank, book_id, title,
  coalesce(author, 'Unknown') as author, category, summary, round(s, 4) as similarity_score, round(s * 100, 2) as match_percentage
from nearest""")
def _(spark, d):
    return _book_flow(spark, d)[1]


@query("book_recommendation_outcomes", f"""with {BOOK_HITS}, n as (select query_id, count(*) as n from nearest group by 1)
select query_id, case when length(query) > 500 then 'error' else 'ok' end as status, coalesce(n, 0) as total,
  case when length(query) > 500 then 'Query too long. Maximum 500 characters allowed'
       when n is null then 'No recommendations found' else 'Recommendations fetched successfully' end as message
from asked left join n using (query_id)""")
def _(spark, d):
    return books.outcomes(*_book_flow(spark, d))


@query("book_outcomes_without_books", f"""with {BOOK_HITS}
select query_id, case when length(query) > 500 then 'error' else 'no_results' end as status, 0::BIGINT as total,
  case when length(query) > 500 then 'Query too long. Maximum 500 characters allowed'
       else 'No books found matching ''' || query || '''. Try a different query.' end as message from asked""")
def _(spark, d):
    asked, hits = _book_flow(spark, d)
    none = tables.table(spark, d, "embeddings").where(F.size("embedding") == 0)
    return books.outcomes(asked, hits.join(none.select(F.col("vec_id").alias("book_id")), "book_id", "left_semi"), none)


SHOWN = f"""{HYBRID}, open_ones as (select * from hybrid where is_oa),
cut as (select * from (select * exclude (rank), row_number() over (partition by query_id order by citations desc, branch, place)::INT as rank
        from open_ones) where rank <= 5)"""


def _open_papers(spark, d):
    rows = tables.papers(spark, d).withColumn("doi", F.format_string("10.9/%d", F.col("paper_id")))
    # The paper's own number keeps the order of equal scores the same as in the SQL statement.
    index_table = hashing_embedder()(papers.paper_text(rows), "text", "embedding")
    return journals.recommend_papers(tables.queries(spark, d), index_table, hashing_embedder(), 5, "open_access")


@query("paper_recommendation", f"""with {SHOWN}
select query_id, rank, coalesce(nullif(title, ''), 'Untitled') as title, '10.9/' || paper_id as doi, year,
  {q.strip('abstract')} as abstract, case when length({q.strip('abstract')}) > 320 then substr({q.strip('abstract')}, 1, 320) || '...'
  else {q.strip('abstract')} end as summary, citations, publisher, is_oa, pdf,
  coalesce(pdf, 'https://doi.org/10.9%2F' || paper_id) as source_url, round(s, 4) as similarity_score, round(s * 100, 2) as match_percentage
from (select *, coalesce(citations::DOUBLE / nullif(max(citations) over (partition by query_id), 0), 0.0) as s from cut)""")
def _(spark, d):
    return _open_papers(spark, d)


@query("paper_recommendation_outcomes", f"""with {SHOWN}, n as (select query_id, count(*) as n from cut group by 1)
select query_id, case when n is null then 'no_results' else 'ok' end as status, coalesce(n, 0) as total,
  case when n is null then 'No journals found matching your query.' else 'Journal recommendations fetched successfully' end as message
from queries left join n using (query_id)""")
def _(spark, d):
    return journals.outcomes(tables.queries(spark, d), _open_papers(spark, d))


FLOW_PAPERS = q.PAPERS.replace("papers as (", "raw_papers as (", 1).replace("from papers)", "from raw_papers)") + f""",
flow_rows as (
  select query_id, pos, '10.9/' || paper_id as paper_id, title, year, abstract, citations, publisher, pdf is not null as is_oa,
    coalesce(pdf, '') as pdf from candidates_ where query_id % 2 = 0 union all
  select query_id, pos, '10.9/' || paper_id, title, year, array_to_string({q.words('title')}, ' '), citations, publisher, is_oa,
    coalesce(pdf, '') from candidates_ where query_id % 2 = 1),
papers as (select * exclude (query_id, pos, seen) from (
  select *, row_number() over (partition by query_id, title order by pos) as seen from flow_rows) where seen = 1)"""

FLOW_SHOWN = f"""known as (select * from hybrid where regexp_matches(lower(publisher), '{'|'.join(fv.SUBSCRIPTION_PUBLISHERS)}')),
allowed as (select * from known union all select * from hybrid where not is_oa and query_id not in (select query_id from known)),
cut as (select * from (select * exclude (rank), row_number() over (partition by query_id order by citations desc, branch, place)::INT
          as rank from allowed) where rank <= 5)"""


def _source_rows(spark, d):
    """Every paper as a raw row of both paper services; the first one answers every other query only."""
    rows = tables.candidate_papers(spark, d).withColumn("doi", F.format_string("10.9/%d", F.col("paper_id")))
    graph = rows.where("query_id % 2 = 0").select(
        "query_id", "pos", "title", F.col("doi").alias("paperId"), "year", "abstract", F.col("publisher").alias("venue"),
        F.col("citations").alias("citationCount"),
        F.when(F.col("pdf").isNotNull(), F.struct(F.col("pdf").alias("url"))).alias("openAccessPdf"))
    works = rows.select(
        "query_id", "pos", "title", F.col("doi").alias("id"), F.col("year").alias("publication_year"),
        F.col("citations").alias("cited_by_count"),
        tx.inverted_words(F.array("title")).alias("abstract_inverted_index"),
        F.struct("publisher").alias("host_venue"), F.struct("is_oa", F.col("pdf").alias("oa_url")).alias("open_access"))
    return (papers.from_graph_source(graph, "query_id", "pos"), papers.from_works_source(works, "query_id", "pos"))


@query("paper_flow", f"""with {HYBRID.replace(q.PAPERS, FLOW_PAPERS)}, {FLOW_SHOWN}
select query_id, rank, coalesce(nullif(title, ''), 'Untitled') as title, paper_id as doi, year, {q.strip('abstract')} as abstract,
  citations, publisher, is_oa, coalesce(nullif(pdf, ''), 'https://doi.org/' || replace(paper_id, '/', '%2F')) as source_url,
  round(s, 4) as similarity_score, round(s * 100, 2) as match_percentage
from (select *, coalesce(citations::DOUBLE / nullif(max(citations) over (partition by query_id), 0), 0.0) as s from cut)""")
def _(spark, d):
    shown = journals.answer_queries(tables.queries(spark, d), *_source_rows(spark, d), shared_folder(spark, "papers"),
                                    hashing_embedder(), 5, "subscription")
    return shown.drop("pdf", "summary")


@query("paper_flow_without_vectors", f"""with {FLOW_PAPERS}, firsts as (
  select query_id, paper_id, pos, is_oa, row_number() over (partition by query_id, title order by pos) as seen from flow_rows),
cut as (select *, row_number() over (partition by query_id order by pos)::INT as rank from firsts where seen = 1 and is_oa)
select query_id, rank, paper_id as doi from cut where rank <= 5""")
def _(spark, d):
    shown = journals.answer_queries(tables.queries(spark, d), *_source_rows(spark, d), shared_folder(spark, "papers"),
                                    None, 5, "open_access")
    return shown.select("query_id", "rank", "doi")


@query("papers_delivered_twice", """select '10.9/' || doc_id as paper_id, 1::BIGINT as stored, length(string_split(text, chr(10))[1] || ' ' || text) as chars
from documents""")
def _(spark, d):
    rows = tables.papers(spark, d).withColumn("doi", F.format_string("10.9/%d", F.col("paper_id"))).drop("paper_id")
    path = shared_folder(spark, "papers")
    journals.grow_index(rows.where("citations < 200"), path, hashing_embedder())
    held = journals.grow_index(rows, path, hashing_embedder())
    return held.groupBy("paper_id").agg(F.count("*").alias("stored"), F.max(F.length("text")).cast("long").alias("chars"))


@query("books_delivered_twice", """select p_partkey as book_id, 1::BIGINT as stored, 384 as dim from part""")
def _(spark, d):
    path = shared_folder(spark, "books")
    rows = tables.recommender_books(spark, d)

    def embed(fresh):
        return hashing_embedder(384)(fresh, "summary", "embedding")
    insert_if_absent(rows.where("processed"), path, "book_id", embed)
    insert_if_absent(rows.unionByName(rows), path, "book_id", embed)
    return stored(spark, path).groupBy("book_id").agg(
        F.count("*").alias("stored"), F.max(F.size("embedding")).alias("dim"))


@query("collections_replaced", """select 'book-' || label as book_uid, count(*) as rows, min(vec_id) as first_chunk, max(vec_id) as last_chunk
from embeddings where label >= 5 or vec_id % 2 = 0 group by label""")
def _(spark, d):
    path = shared_folder(spark, "collections")
    rows = tables.collections(spark, d)
    write_collections(rows, path)
    again = rows.where("int(substr(book_uid, 6)) < 5 and chunk_id % 2 = 0")
    write_collections(again, path)
    return spark.read.parquet(path).groupBy("book_uid").agg(
        F.count("*").alias("rows"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"))


STOPPED = "stopped half way"


@query("staged_run_resumed", f"""with cleaned as (select doc_id, {q.clean('text')} as text from documents)
select doc_id, len({q.tokens('text')})::INT as n_words, md5(text) as digest from cleaned""")
def _(spark, d):
    def cleaned(rows):
        return rows.select("doc_id", tx.clean_text(F.col("text")).alias("text"))

    def counted(rows):
        return rows.select("*", F.size(tx.tokens(F.col("text"))).alias("n_words"))

    def digested(rows):
        return rows.select("doc_id", "n_words", F.md5(F.col("text").cast("binary")).alias("digest"))

    def dying(rows):
        dies = F.when(F.col("doc_id") % 7 == 3, F.raise_error(F.lit(STOPPED)).cast("int")).otherwise(F.col("n_words"))
        return digested(rows.withColumn("n_words", dies))

    folder, docs = shared_folder(spark, "stages"), tables.table(spark, d, "documents").select("doc_id", "text")
    before = [("cleaned", cleaned), ("counted", counted)]
    try:
        run_stages([*before, ("digested", dying)], docs, folder)
    except PySparkException as error:
        if STOPPED not in str(error):
            raise
    return run_stages([*before, ("digested", digested)], docs, folder, resume=True)


@query("text_file_lines", """with lines as (select source, unnest(string_split(text, chr(10))) as line from documents)
select source, count(*) as lines, sum(length(line))::BIGINT as chars, sum(('0x' || substr(md5(line), 1, 8))::BIGINT)::BIGINT as digests
from lines group by source""")
def _(spark, d):
    """Documents written as text files, one folder for each source, and read back in segments."""
    path = shared_folder(spark, "texts")
    docs = tables.table(spark, d, "documents").where("text is not null")
    docs.select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    segments = files.text_segments(spark, path, chars=4096)
    line = segments.select(F.regexp_extract("file", "/source=([^/]+)/", 1).alias("source"),
                           F.explode(F.split("text", "\n")).alias("line"))
    digest = F.conv(F.substring(F.md5(F.col("line").cast("binary")), 1, 8), 16, 10).cast("long")
    return line.groupBy("source").agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).cast("long").alias("chars"), F.sum(digest).alias("digests"))


@query("prefixed_query_vectors", f"""with asked as (select item_id as query_id, '{fv.QUERY_PREFIX}' || text as query from benchmark),
_slots_query_id as ({q.slots('asked', 'query_id', 'query')}), prefixed as ({q.hashed('asked', 'query_id', 'query')}),
_slots_item_id as ({q.slots('benchmark', 'item_id', 'text')}), plain as ({q.hashed('benchmark', 'item_id', 'text')})
select query_id, i - 1 as slot, round(prefixed.v[i], 5) as value, round(plain.v[i], 5) as without_prefix
from prefixed join plain on query_id = item_id, range(1, 65) r(i)""")
def _(spark, d):
    asked, embedder = tables.queries(spark, d), hashing_embedder()
    plain = embedder(asked, "query", "plain").select("query_id", "plain")
    both = passages.embed_queries(asked, embedder).select("query_id", "embedding").join(plain, "query_id")
    slots = both.select("query_id", F.posexplode(F.arrays_zip("embedding", "plain")).alias("slot", "v"))
    return slots.select("query_id", F.col("slot").cast("long").alias("slot"),
                        F.round(F.col("v.embedding").cast("double"), 5).alias("value"),
                        F.round(F.col("v.plain").cast("double"), 5).alias("without_prefix"))


def _delivered(spark, rows, deliveries: int = 3):
    """``rows`` as a stream of that many micro-batches."""
    path = shared_folder(spark, "deliveries")
    rows.repartition(deliveries).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("streamed_active_book", f"with {ACTIVE} select * from active")
def _(spark, d):
    live = incremental.live_active_book(_delivered(spark, scans(spark, d)), "user_id", "uid", "ts", "event_id")
    path = shared_folder(spark, "active")
    run = incremental.keep_latest(live, path, shared_folder(spark, "progress"))
    run.trigger(availableNow=True).start().awaitTermination()
    return incremental.latest(spark, path, "user_id")


@query("streamed_index", """select p_partkey as book_id, 1::BIGINT as entries, 64 as dim,
  round(case when p_name is null or p_name = '' then 0.0 else 1.0 end, 4)::DOUBLE as norm from part""")
def _(spark, d):
    """Every part delivered twice in micro-batches; the index holds each once."""
    part = tables.table(spark, d, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("summary"))
    path = shared_folder(spark, "index")
    for _round in range(2):
        run = incremental.maintain_index(_delivered(spark, part), hashing_embedder(), "summary", "book_id", path,
                                         shared_folder(spark, "progress"))
        run.trigger(availableNow=True).start().awaitTermination()
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return spark.read.parquet(path).groupBy("book_id").agg(
        F.count("*").alias("entries"), F.max(F.size("embedding")).alias("dim"), F.round(F.sqrt(F.max(total)), 4).alias("norm"))

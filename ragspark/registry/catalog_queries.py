"""Catalog, keyword recommendation and index maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.operators import catalog, keywords, pages
from ragspark.plans import books as flows
from ragspark.registry import query, tables
from ragspark.registry import sql as q
from ragspark.session import shared_folder
from ragspark.sources import tables as sinks


@query("catalog_scan", f"""with {q.BOOKS} select id, uid, title, author, isbn, topic, description,
  cover_image_url as "coverImageUrl", published_year as "publishedYear" from books""")
def _(spark, d):
    return catalog.api_view(tables.books(spark, d))


@query("unprocessed_books", f"""with {q.RECOMMENDER} select book_id, title, author, category, summary from recommender
where not processed or processed is null order by book_id""")
def _(spark, d):
    return catalog.unprocessed(tables.recommender_books(spark, d))


@query("catalog_search", f"""with {q.BOOKS} select id, title from books
where title ilike '%RE_ _%' or author ilike '%RE_ _%' or isbn ilike '%RE_ _%' or topic ilike '%RE_ _%'""")
def _(spark, d):
    return catalog.search(tables.books(spark, d), " RE_ _ ").select("id", "title")


@query("catalog_page", f"""with {q.BOOKS}, f as (select * from books where title ilike '%bolt%' or author ilike '%bolt%'
  or isbn ilike '%bolt%' or topic ilike '%bolt%')
select id, uid, title, author, isbn, topic, description, cover_image_url as "coverImageUrl", published_year as "publishedYear",
  2 as page, (select count(*) from f) as total, 10 as page_size from f order by title, id limit 10 offset 10""")
def _(spark, d):
    return catalog.list_books(tables.books(spark, d), "bolt", 2, 10)


@query("catalog_deep_page", f"""with {q.BOOKS}
select id, uid, title from books order by title, id limit 20 offset 160""")
def _(spark, d):
    """Page 9 of all books, from the stored order."""
    index = pages.page_index(tables.books(spark, d).select("id", "uid", "title"), ["title", "id"], part_rows=50)
    return pages.page(index, 9, 20)


@query("catalog_next_rows", f"""with {q.BOOKS}, placed as (select id, uid, title, row_number() over (order by title, id) as n from books)
select id, uid, title from placed where n between 101 and 130""")
def _(spark, d):
    """The thirty books behind the hundredth, found by its key."""
    index = pages.page_index(tables.books(spark, d).select("id", "uid", "title"), ["title", "id"], part_rows=40)
    last = pages.page(index, 100, 1).first()
    return pages.after(index, (last["title"], last["id"]), 30)


@query("catalog_total", f"with {q.BOOKS} select count(*) as total from books where concat_ws('|', title, author, isbn, topic) ilike '%small%'")
def _(spark, d):
    return catalog.total(catalog.search(tables.books(spark, d), "small"))


@query("catalog_lookup", f"""with {q.BOOKS}, refs as (select case when event_id % 2 = 0 then 'book-' || event_id else user_id::VARCHAR end as ref from events),
u as (select r.ref, b.* from refs r join books b on r.ref = b.uid)
select ref, id, title from u union all
select r.ref, b.id, b.title from refs r join books b on try_cast(r.ref as INT) = b.id where r.ref not in (select uid from books)""")
def _(spark, d):
    i = F.col("event_id")
    refs = tables.table(spark, d, "events").select(
        F.when(i % 2 == 0, F.concat(F.lit("book-"), i.cast("string"))).otherwise(F.col("user_id").cast("string")).alias("ref"))
    return catalog.lookup(refs, tables.books(spark, d)).select("ref", "id", "title")


CANONICAL = f"""{q.BOOKS}, canonical as (
  select case when id % 6 = 1 then 'new-' || id else uid end as uid, title, author, isbn,
         case when id % 5 = 0 then topic || '!' else topic end as topic, description, cover_image_url, published_year
  from books where published_year < 2030
  union all select 'sup-' || s_suppkey, s_name, 'maker', null, null, null, null, 2000 from supplier),
matched as (
  select c.*, coalesce(u.id, i.id) as id, coalesce(u.uid, i.uid) as old_uid, coalesce(u.topic, i.topic) as old_topic
  from canonical c left join books u on u.uid = c.uid left join books i on u.uid is null and i.isbn = c.isbn),
plan as (
  select uid, id, case when id is null then 'insert'
    when uid is distinct from old_uid or topic is distinct from old_topic then 'update' else 'unchanged' end as action from matched
  union all select uid, id, case when starts_with(uid, 'book-') then 'delete' else 'keep' end
  from books where id not in (select id from matched where id is not null))"""


def _merge_plan(spark, d):
    held = tables.books(spark, d)
    i = F.col("id")
    renewed = held.where(F.col("published_year") < 2030).select(
        F.when(i % 6 == 1, F.concat(F.lit("new-"), i.cast("string"))).otherwise(F.col("uid")).alias("uid"),
        "title", "author", "isbn",
        F.when(i % 5 == 0, F.concat("topic", F.lit("!"))).otherwise(F.col("topic")).alias("topic"),
        "description", "cover_image_url", "published_year")
    none = F.lit(None).cast("string")
    added = tables.table(spark, d, "supplier").select(
        F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")).alias("uid"), F.col("s_name").alias("title"),
        F.lit("maker").alias("author"), none.alias("isbn"), none.alias("topic"), none.alias("description"),
        none.alias("cover_image_url"), F.lit(2000).alias("published_year"))
    return catalog.merge_plan(held, renewed.unionByName(added))


@query("canonical_merge", f"with {CANONICAL} select uid, id, action from plan")
def _(spark, d):
    return _merge_plan(spark, d).select("uid", "id", "action")


@query("canonical_merge_written", f"""with {CANONICAL}, kept as (select * from plan where action <> 'delete')
select uid, case when id is not null then id else (select max(id) from books)
  + row_number() over (partition by id is null order by uid) end::INT as id from kept""")
def _(spark, d):
    """The merged catalog written as a new version of a table and read back."""
    return catalog.write_merged(_merge_plan(spark, d), shared_folder(spark, "catalog")).select("uid", "id")


@query("canonical_merge_counts", f"with {CANONICAL} select action, count(*) as rows from plan group by 1")
def _(spark, d):
    return catalog.merge_counts(_merge_plan(spark, d))


@query("title_lookup", """select c_custkey, coalesce(r_name, 'Unknown Title') as book_title from customer
left join region on r_regionkey = c_nationkey""")
def _(spark, d):
    rows = tables.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("book_uid"))
    titles = tables.table(spark, d, "region").select(F.col("r_regionkey").alias("book_uid"), F.col("r_name").alias("title"))
    return catalog.resolve_titles(rows, titles).select("c_custkey", "book_title")


OVERLAP = f"""{q.RECOMMENDER}, terms as (select query_id, unnest({q.ordered_distinct(q.words('lower(query)'))}) as term from questions),
scores as (select query_id, book_id, count(*) as score from terms, recommender
  where contains(lower(concat_ws(' ', title, author, category, summary)), term) group by all),
ranked as (select * from (select *, row_number() over (partition by query_id order by score desc, book_id)::INT as rank from scores)
  where rank <= 5)"""


@query("keyword_overlap", f"with {OVERLAP} select query_id, book_id, score from scores")
def _(spark, d):
    return keywords.overlap_scores(tables.book_questions(spark, d), tables.recommender_books(spark, d))


@query("keyword_recommendation", f"""with {OVERLAP} select query_id, rank, book_id, title, author, category, summary, score,
  round(s, 4) as similarity_score, round(round(s, 4) * 100, 2) as match_percentage from (
  select *, score::DOUBLE / max(score) over (partition by query_id) as s from ranked) join recommender using (book_id)""")
def _(spark, d):
    return flows.recommend_by_keyword(tables.book_questions(spark, d), tables.recommender_books(spark, d))


@query("keyword_recommendation_outcomes", f"""with {OVERLAP}, n as (select query_id, count(*) as n from ranked where query_id % 5 > 1 group by 1)
select query_id, case when n is null then 'no_results' else 'ok' end as status, coalesce(n, 0) as total,
  case when query_id % 5 = 0 then 'Please provide a meaningful query.' when n is null then 'No books found matching your query.'
       else 'Recommendations fetched successfully (fallback mode)' end as message from questions left join n using (query_id)""")
def _(spark, d):
    which = F.col("query_id") % 5
    asked = tables.book_questions(spark, d).withColumn("query", F.when(which == 0, " \t ").when(which == 1, "zz@zz").otherwise(F.col("query")))
    return flows.keyword_outcomes(asked, flows.recommend_by_keyword(asked, tables.recommender_books(spark, d)))


DELIVERY = f"""{q.RECOMMENDER}, held as (select book_id from recommender where processed),
batch as (select l_partkey as book_id from lineitem union all select book_id from recommender),
keys as (select book_id, count(*) as n, book_id in (select book_id from held) as held, book_id % 17 = 0 as broken from batch group by all),
status as (
  select book_id, 'successful' as status, 1::BIGINT as rows from keys where not held and not broken union all
  select book_id, 'failed', n from keys where not held and broken union all
  select book_id, 'duplicate', case when held then n else n - 1 end from keys where held or (not broken and n > 1))"""


def _delivery(spark, d):
    held = tables.recommender_books(spark, d).where(F.col("processed"))
    again = tables.table(spark, d, "lineitem").select(F.col("l_partkey").alias("book_id"))
    batch = again.unionByName(tables.recommender_books(spark, d).select("book_id"))
    vector = F.when(F.col("book_id") % 17 != 0, F.array(F.col("book_id").cast("float")))
    return sinks.delivery_status(batch.withColumn("embedding", vector), held, "book_id")


@query("delivery_status", f"with {DELIVERY} select * from status")
def _(spark, d):
    return _delivery(spark, d)


@query("delivery_counts", f"with {DELIVERY} select status, sum(rows)::BIGINT as rows from status group by 1")
def _(spark, d):
    return sinks.status_counts(_delivery(spark, d))


@query("marked_processed", f"""with {DELIVERY} select r.book_id, coalesce(s.book_id is not null or r.processed, false) as processed
from recommender r left join (select distinct book_id from status where status <> 'failed') s using (book_id)""")
def _(spark, d):
    marked = sinks.mark_processed(tables.recommender_books(spark, d), _delivery(spark, d))
    return marked.select("book_id", "processed")


@query("absent_documents", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def _(spark, d):
    index = tables.table(spark, d, "labels")
    return sinks.new_rows(tables.table(spark, d, "documents").select("doc_id"), index, "doc_id")

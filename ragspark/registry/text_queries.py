"""Text, validation, chunking, cleaning and request queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.functions import scalars as sc
from ragspark.functions import text as tx
from ragspark.operators import chunking, context, quality, requests
from ragspark.registry import query, tables
from ragspark.registry import sql as q
from ragspark.sources import files
from ragspark.sources import tables as sinks

STAMP = "timestamp'2026-01-02 03:04:05'"


@query("query_keywords", f"""with {q.QUERIES}
select query_id, array_to_string({q.keywords('query')}, ' ') as keywords from queries""")
def _(spark, d):
    return tables.queries(spark, d).select(
        "query_id", F.array_join(tx.query_keywords(F.col("query")), " ").alias("keywords"))


@query("text_signals", f"""with {q.SIGNALS}
select doc_id, keyword_hits, round(pronoun_ratio, 6) as pronoun_ratio, has_structure,
       {q.forum_source('url')} as forum_source, {q.noise('content')} as forum_noise,
       {q.code_share('content')} >= 0.35 as code_mixture, {q.penalty('content')} as penalty,
       {q.estimate('content')}::INT as token_estimate from signals""")
def _(spark, d):
    c = F.col("content")
    return tables.web_results(spark, d).select(
        "doc_id",
        tx.keyword_hits(c, tx.query_keywords(F.col("query"))).alias("keyword_hits"),
        F.round(tx.pronoun_ratio(c), 6).alias("pronoun_ratio"),
        tx.has_structure(c).alias("has_structure"),
        tx.is_forum_source(F.col("url")).alias("forum_source"),
        tx.has_forum_noise(c).alias("forum_noise"),
        tx.has_code_mixture(c).alias("code_mixture"),
        tx.answer_penalty(c).alias("penalty"),
        tx.token_estimate(c).alias("token_estimate"),
    )


@query("page_forum_hosts", f"""select page_id, {q.forum_source("replace(url, 'example.org', 'stackexchange.com')")} as forum
from pages""")
def _(spark, d):
    url = F.replace("url", F.lit("example.org"), F.lit("stackexchange.com"))
    return tables.table(spark, d, "pages").select("page_id", tx.is_forum_source(url).alias("forum"))


@query("coarse_validation", f"""with {q.SIGNALS}
select doc_id, query_id, url, score from signals where score >= 0.6 and content_chars >= 800""")
def _(spark, d):
    return quality.coarse_valid(tables.web_results(spark, d)).select("doc_id", "query_id", "url", "score")


@query("fine_validation", f"""with {q.SIGNALS}
select doc_id, query_id, url from signals where has_structure and keyword_hits >= 1 and pronoun_ratio <= 0.02""")
def _(spark, d):
    return quality.fine_valid(tables.web_results(spark, d)).select("doc_id", "query_id", "url")


@query("strict_filter", f"with {q.SIGNALS} select query_id, pos, url, score, content from signals where {q.VALID}")
def _(spark, d):
    return quality.strict_filter(tables.web_results(spark, d)).select("query_id", "pos", "url", "score", "content")


@query("rejection_audit", f"""with {q.SIGNALS}
select query_id, case when score < 0.6 then 'low_score' when content_chars < 800 then 'short_content'
  when not has_structure then 'no_structure' when keyword_hits < 1 then 'no_keyword'
  when pronoun_ratio > 0.02 then 'conversational' else 'kept' end as reason, count(*) as rows
from signals group by all""")
def _(spark, d):
    return quality.rejection_audit(tables.web_results(spark, d))


@query("filter_with_fallback", f"with {q.FILTERED} select query_id, pos, url, score, content from filtered")
def _(spark, d):
    return quality.filter_with_fallback(tables.web_results(spark, d)).select(
        "query_id", "pos", "url", "score", "content")


@query("filter_label_agreement", f"""with {q.SIGNALS}
select l.quality, count(*) as rows, count(*) filter (where {q.VALID}) as kept
from signals s join labels l using (doc_id) group by all""")
def _(spark, d):
    judged = tables.web_results(spark, d).withColumn("kept", quality.reject_reason().isNull())
    return judged.select("doc_id", "kept").join(tables.table(spark, d, "labels"), "doc_id").groupBy("quality").agg(
        F.count("*").alias("rows"), F.count_if("kept").alias("kept"))


@query("sentence_blocks", rf"""
select doc_id, generate_subscripts(b, 1)::INT - 1 as block, unnest(b) as text from (
  select doc_id, list_filter(list_transform(
    regexp_split_to_array(regexp_replace(regexp_replace(text, '\n+', chr(10), 'g'), '\.\s+([A-Z])', '.' || chr(1) || '\1', 'g'),
                          chr(1)), lambda b: {q.strip('b')}), lambda b: b <> '') as b from documents)""")
def _(spark, d):
    docs = tables.table(spark, d, "documents")
    return chunking.exploded(docs, ["doc_id"], tx.sentence_blocks(F.col("text")), "block", "text")


CHUNK_SQL = rf"""
blocks as (
  select *, row_number() over (partition by doc order by i) as n from (
    select doc, generate_subscripts(b, 1) as i, unnest(b) as text, len(regexp_extract_all(unnest(b), '{q.WORD}')) as tok
    from (select doc, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(content, '\n+', chr(10), 'g'),
            '\.\s+([A-Z])', '.' || chr(1) || '\1', 'g'), chr(1)), lambda b: {q.strip('b')}), lambda b: b <> '') as b
          from source_texts)) where tok > 0),
window_walk as (
  select doc, 0::BIGINT as n, []::STRUCT(text VARCHAR, tok BIGINT)[] as done, []::VARCHAR[] as win, []::BIGINT[] as toks
  from source_texts
  union all
  select w.doc, b.n,
    case when b.tok > 300 then list_concat(w.done, list_transform(
           list_transform(range(0, len({q.words('b.text')}), 300),
                          lambda s: array_to_string({q.words('b.text')}[s + 1:s + 300], ' ')),
           lambda p: struct_pack(text := p, tok := len(regexp_extract_all(p, '{q.WORD}'))::BIGINT)))
         when coalesce(list_sum(w.toks), 0) + b.tok > 300 and coalesce(list_sum(w.toks), 0) >= 200
         then list_append(w.done, struct_pack(text := array_to_string(w.win, chr(10) || chr(10)),
                                              tok := list_sum(w.toks)::BIGINT))
         else w.done end,
    case when b.tok > 300 then w.win
         when coalesce(list_sum(w.toks), 0) + b.tok <= 300 then list_append(w.win, b.text)
         else list_append(list_filter(w.win, lambda x, i: coalesce(list_sum(w.toks[i + 1:]), 0) < 50), b.text) end,
    case when b.tok > 300 then w.toks
         when coalesce(list_sum(w.toks), 0) + b.tok <= 300 then list_append(w.toks, b.tok)
         else list_append(list_filter(w.toks, lambda x, i: coalesce(list_sum(w.toks[i + 1:]), 0) < 50), b.tok) end
  from window_walk w join blocks b on b.doc = w.doc and b.n = w.n + 1),
window_last as (
  select doc, done, len(win) > 0 as open, array_to_string(win, chr(10) || chr(10)) as tail,
         coalesce(list_sum(toks), 0)::BIGINT as tail_tok
  from window_walk w where n = (select coalesce(max(n), 0) from blocks b where b.doc = w.doc)),
raw_chunks as (
  select doc, case when not open then done
    when tail_tok < 200 and len(done) > 0 and done[-1].tok + tail_tok <= 450
      then list_append(done[:-2], struct_pack(text := done[-1].text || chr(10) || chr(10) || tail,
                                              tok := done[-1].tok + tail_tok))
    else list_append(done, struct_pack(text := tail, tok := tail_tok)) end as c from window_last),
chunk_rows as (select doc, generate_subscripts(c, 1) as n, unnest(c).text as text, unnest(c).tok as tok from raw_chunks),
merge_walk as (
  select doc, 0::BIGINT as n, []::STRUCT(text VARCHAR, tok BIGINT, section BIGINT)[] as done, 0::BIGINT as skip
  from source_texts
  union all
  select m.doc, c.n,
    case when m.skip = c.n then m.done
      when c.tok < 200 and len(m.done) > 0 and m.done[-1].tok + c.tok <= 450
        then list_append(m.done[:-2], struct_pack(text := m.done[-1].text || chr(10) || chr(10) || c.text,
                                                  tok := m.done[-1].tok + c.tok, section := m.done[-1].section))
      when c.tok < 200 and nxt.tok is not null and c.tok + nxt.tok <= 450
        then list_append(m.done, struct_pack(text := c.text || chr(10) || chr(10) || nxt.text, tok := c.tok + nxt.tok,
                                             section := c.n - 1))
      else list_append(m.done, struct_pack(text := c.text, tok := c.tok, section := c.n - 1)) end,
    case when m.skip <> c.n and c.tok < 200 and not (len(m.done) > 0 and coalesce(m.done[-1].tok, 0) + c.tok <= 450)
              and nxt.tok is not null and c.tok + nxt.tok <= 450 then c.n + 1 else 0 end
  from merge_walk m join chunk_rows c on c.doc = m.doc and c.n = m.n + 1
  left join chunk_rows nxt on nxt.doc = c.doc and nxt.n = c.n + 1),
merged as (
  select doc, done from merge_walk m where n = (select coalesce(max(n), 0) from chunk_rows c where c.doc = m.doc)),
merged_chunks as (
  select doc, generate_subscripts(done, 1)::INT - 1 as part, unnest(done).section::INT as section_index,
         unnest(done).text as chunk_text, unnest(done).tok::INT as token_estimate from merged)"""


@query("window_chunks", f"""with recursive source_texts as (select doc_id as doc, text as content from documents), {CHUNK_SQL}
select doc as doc_id, n::INT - 1 as section, text, tok::INT as tok from chunk_rows""")
def _(spark, d):
    chunked = chunking.window_chunks(tables.table(spark, d, "documents"), "text")
    rows = chunking.exploded(chunked, ["doc_id"], F.col("chunks"), "part", "c")
    return rows.select("doc_id", "c.section", "c.text", "c.tok")


@query("result_chunks", f"""with recursive {q.WEB}, source_texts as (select doc_id as doc, content from web), {CHUNK_SQL}
select w.query_id, w.pos, w.url as source, w.score as tavily_score, m.part, m.section_index, m.chunk_text, m.token_estimate
from merged_chunks m join web w on w.doc_id = m.doc""")
def _(spark, d):
    return chunking.chunk_results(tables.web_results(spark, d))


ROW_CHUNKS, ROW_MERGE = CHUNK_SQL.split("merge_walk as (", 1)
RUN_MERGE = "merge_walk as (" + ROW_MERGE.replace("source_texts", "run_texts").replace("chunk_rows", "run_chunks")


@query("repeated_source_chunks", f"""with recursive {q.WEB}, source_texts as (select doc_id as doc, content from web), {ROW_CHUNKS}
run_chunks as (
  select run as doc, row_number() over (partition by run order by pos, n) as n, text, tok, query_id, pos, n::INT - 1 as section
  from (select *, query_id * 1000000 + case when query_id % 5 = 0 then 0 else pos // 3 end as run from web) w
  join chunk_rows c on c.doc = w.doc_id),
run_texts as (select distinct doc from run_chunks), {RUN_MERGE}
select r.query_id, r.pos, r.section as section_index, m.chunk_text, m.token_estimate
from merged_chunks m join run_chunks r on r.doc = m.doc and r.n = m.section_index + 1""")
def _(spark, d):
    rows = tables.web_results(spark, d)
    site = F.when(F.col("query_id") % 5 == 0, F.lit("all")).otherwise(F.floor(F.col("pos") / 3).cast("string"))
    chunks = chunking.chunk_results(rows.withColumn("url", F.concat(F.lit("https://site.example.com/"), site)))
    return chunks.select("query_id", "pos", "section_index", "chunk_text", "token_estimate")


BOOK_CHUNKS = f"""recursive books as (select 'book-' || doc_id as doc, {q.clean('text')} as text from documents),
{q.character_split('books')}"""


@query("character_split", f"""with {BOOK_CHUNKS}
select doc as book_uid, chunk_id, text, length(text)::INT as length, len({q.words('text')})::INT as word_count,
  length(text)::INT as char_count from split_chunks""")
def _(spark, d):
    docs = tables.table(spark, d, "documents")
    return chunking.split_book(docs.select(
        F.concat(F.lit("book-"), F.col("doc_id").cast("string")).alias("book_uid"),
        tx.clean_text(F.col("text")).alias("text")))


@query("clean_text", f"select doc_id, {q.clean('text')} as cleaned from documents")
def _(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query("page_cleaning_totals", f"""select url.split('/')[3] as host, count(*) as pages, sum(length(html))::BIGINT as chars_before,
  sum(length({q.clean('html')}))::BIGINT as chars_after, sum(length(html) - length({q.clean('html')}))::BIGINT as removed
from pages group by all""")
def _(spark, d):
    before, after = F.length("html"), F.length(tx.clean_text(F.col("html")))
    sized = tables.table(spark, d, "pages").select(
        F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), before.alias("b"), after.alias("a"))
    return sized.groupBy("host").agg(
        F.count("*").alias("pages"), F.sum("b").alias("chars_before"), F.sum("a").alias("chars_after"),
        F.sum(F.col("b") - F.col("a")).alias("removed"))


@query("collapsed_whitespace", f"""
select doc_id, coalesce(nullif(array_to_string({q.words('text')}, ' '), ''), '[EMPTY]') as collapsed from documents""")
def _(spark, d):
    return tables.table(spark, d, "documents").select(
        "doc_id", tx.collapse_whitespace(F.col("text")).alias("collapsed"))


@query("tokenisation", f"""
with w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i
           from (select doc_id, {q.words('text')} as ws from documents)),
first as (select doc_id, lower(w) as term, min(i) as place, count(*) as n from w group by all)
select d.doc_id, coalesce(sum(n), 0)::INT as words, coalesce(string_agg(term, ' ' order by place), '') as terms
from documents d left join first f using (doc_id) group by 1""")
def _(spark, d):
    t = F.col("text")
    return tables.table(spark, d, "documents").select(
        "doc_id", tx.word_count(t).alias("words"), F.array_join(tx.query_terms(t), " ").alias("terms"))


@query("chunk_metadata", f"""with {q.LINES}
select book_uid, chunk_id, text, length(text)::INT as length, len({q.words('text')})::INT as word_count,
       length(text)::INT as char_count from lines""")
def _(spark, d):
    return chunking.chunk_metadata(tables.lines(spark, d))


@query("chunk_statistics", f"""with {q.LINES},
m as (select book_uid, length(text) as length, len({q.words('text')}) as word_count from lines)
select book_uid, count(*) as total_chunks, round(avg(length), 6) as mean_length, round(avg(word_count), 6) as mean_words,
       min(length)::INT as min_length, max(length)::INT as max_length from m group by 1""")
def _(spark, d):
    return chunking.chunk_statistics(chunking.chunk_metadata(tables.lines(spark, d)))


@query("long_enough_lines", f"""select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {q.strip('l')}),
  lambda l: length(l) > 20).len()::INT as kept from documents""")
def _(spark, d):
    return tables.table(spark, d, "documents").select(
        "doc_id", F.size(chunking.long_enough(F.split("text", "\n"))).alias("kept"))


@query("chunk_validation", f"""with {q.LINES}, s as (select *, {q.strip('text')} as t from lines)
select book_uid, chunk_id, substr(t, 1, 8192) as text, case when chunk_id is null then 'missing_id' when t = '' then 'empty'
  when length(t) < 10 then 'too_short' end as reason, length(t) > 8192 as truncated from s""")
def _(spark, d):
    return files.valid_chunks(tables.lines(spark, d))


@query("payload_rows", """
select doc_id::VARCHAR as query_id, case when doc_id % 9 = 0 then 'UNKNOWN_QUERY' else lang end as query,
  (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT as pos, 'https://' || source as url,
  unnest(string_split(text, chr(10))) as content from documents""")
def _(spark, d):
    docs = tables.table(spark, d, "documents")
    one = F.transform(F.split("text", "\n"), lambda c: F.struct(
        F.concat(F.lit("https://"), "source").alias("url"), c.alias("content"), F.lit("0.5").alias("score")))
    asked = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("lang")).alias("query")
    body = F.to_json(F.struct(asked, F.struct(one.alias("results")).alias("tavily_response")))
    parsed = docs.select(F.col("doc_id").cast("string").alias("query_id"), F.from_json(body, files.SEARCH_PAYLOAD).alias("p"))
    rows, _rejected = files.payload_rows(parsed.select("query_id", "p.query", "p.tavily_response"))
    return rows.select("query_id", "query", "pos", "url", "content")


@query("query_record_rejects", """
select conv_id || '/' || turn as file, 'missing ' || case when role = 'user' and turn > 0 then 'results, book'
  when role = 'user' then 'results' else 'book' end as reason from conversations where role = 'user' or turn > 0""")
def _(spark, d):
    turns = tables.table(spark, d, "conversations")
    body = F.to_json(F.struct(
        F.col("conv_id").cast("string").alias("query_id"), F.col("text").alias("query"),
        F.when(F.col("turn") == 0, F.col("role")).alias("book"),
        F.when(F.col("role") != "user", F.array(F.struct(F.col("text").alias("document")))).alias("results")))
    records = turns.select(F.from_json(body, files.QUERY_FILE).alias("r"),
                           F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("file"))
    return files.check_query_records(records.select("r.*", "file"))[1]


@query("file_book_numbers", """select page_id, case when page_id % 3 = 0 then 1 else page_id::INT end as number from pages""")
def _(spark, d):
    i = F.col("page_id")
    name = F.when(i % 3 == 0, F.lit("notes.json")).otherwise(F.format_string("book-%d_chunks.json", i))
    return tables.table(spark, d, "pages").select("page_id", files.book_number(name).alias("number"))


@query("stage_envelope", f"""with {q.FILTERED}, c as (select query_id, count(*) as n from filtered group by 1),
p as (select query_id, pos // 10 as part, count(*)::INT as listed, arg_min(url, pos) as first_url from filtered group by all)
select q.query_id, q.query, 'stage_1_and_2_validation' as stage, '20260102_030405' as timestamp_utc,
  coalesce(p.part, 0)::BIGINT as part, coalesce(c.n, 0) as num_rows, coalesce(listed, 0) as listed, first_url
from queries q left join c using (query_id) left join p using (query_id)""")
def _(spark, d):
    rows = quality.filter_with_fallback(tables.web_results(spark, d))
    sealed = sinks.envelope(tables.queries(spark, d), rows, "stage_1_and_2_validation", ["url", "score", "content"], "pos",
                            F.expr(STAMP), size=10)
    return sealed.select("query_id", "query", "stage", "timestamp_utc", "part", "num_rows",
                         F.size("rows").alias("listed"), F.get("rows", F.lit(0))["url"].alias("first_url"))


@query("query_validation", rf"""with s as (select doc_id as query_id, {q.strip('text')} as t from documents),
m as (select *, case when length(t) = 0 then 'Query cannot be empty or contain only whitespace'
  when length(t) < 3 then 'Query too short. Minimum 3 characters required'
  when length(t) > 500 then 'Query too long. Maximum 500 characters allowed'
  when not regexp_matches(t, '[a-zA-Z0-9]') then 'Query must contain at least one letter or number' end as message from s)
select query_id, message is null as valid, case when message is null then t else '' end as sanitized, message,
  message is null and regexp_matches(t, '[<>{{}}\[\]\\|`~^]') as unusual from m""")
def _(spark, d):
    asked = tables.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return requests.check_queries(asked).drop("query")


@query("top_k_limits", """with k as (select event_id, floor(value)::INT - 5 as k from events)
select event_id, case when k < 1 then 5 else least(k, 100) end as book_k, greatest(1, least(k, 20)) as paper_k from k""")
def _(spark, d):
    k = F.floor("value").cast("int") - 5
    return tables.table(spark, d, "events").select(
        "event_id", sc.book_top_k(k).alias("book_k"), sc.clamped_top_k(k).alias("paper_k"))


@query("request_routing", f"""with r as (select conv_id || '/' || turn as query_id,
  case when role = 'user' then {q.strip('text')} end as query,
  case when turn % 4 <> 3 then 'book-' || conv_id % 10 end as book from conversations)
select query_id, query, book, case when query is null or book is null then 'error' else 'ok' end as status,
  case when query is null then 'malformed input: query_text must be a non-empty string'
       when book is null then 'missing book selection' end as error,
  case when query is null or book is null then 0.0::DOUBLE end as confidence from r""")
def _(spark, d):
    turn, conv = F.col("turn"), F.col("conv_id")
    asked = tables.table(spark, d, "conversations").select(
        F.concat_ws("/", conv.cast("string"), turn.cast("string")).alias("query_id"),
        F.when(F.col("role") == "user", F.col("text")).otherwise("  ").alias("query"),
        F.when(turn % 4 == 3, " ").otherwise(F.concat(F.lit(" book-"), (conv % 10).cast("string"))).alias("book"))
    return requests.route_requests(asked)


ACTIVE = """active as (select user_id, arg_max('book-' || (event_id % 10), (ts, event_id)) as active_book
  from events where event_type = 'view' group by 1)"""


def scans(spark, d):
    views = tables.table(spark, d, "events").where(F.col("event_type") == "view")
    return views.select("user_id", "ts", "event_id",
                        F.concat(F.lit("book-"), (F.col("event_id") % 10).cast("string")).alias("uid"))


@query("active_book", f"with {ACTIVE} select * from active")
def _(spark, d):
    return requests.active_book(scans(spark, d), "user_id", "uid", "ts", "event_id")


@query("book_resolution", f"""with {ACTIVE}
select event_id, coalesce(case when event_type = 'click' then 'ref-' || event_id end,
  case when event_type = 'error' then 'uid-' || user_id end, active_book) as book
from events left join active using (user_id)""")
def _(spark, d):
    kind = F.col("event_type")
    asked = tables.table(spark, d, "events").select(
        "event_id", "user_id",
        F.when(kind == "click", F.concat(F.lit("ref-"), F.col("event_id").cast("string"))).otherwise("").alias("book_ref"),
        F.lit(None).cast("string").alias("book_uid"),
        F.when(kind == "error", F.concat(F.lit("uid-"), F.col("user_id").cast("string"))).alias("uid"))
    sessions = requests.active_book(scans(spark, d), "user_id", "uid", "ts", "event_id")
    return requests.resolve_book(asked, sessions, "user_id").select("event_id", "book")


MESSAGES = {"error": "No such table: ", "click": "Collection expecting embedding with dimension ",
            "view": "Your system has an unsupported version of sqlite3 ", "signup": "database disk image is malformed "}


@query("error_classification", """with c as (select case event_type when 'error' then 'chroma_storage_corrupt'
    when 'click' then 'chroma_embedding_dimension_mismatch' when 'view' then 'chroma_sqlite_incompatible'
    when 'signup' then 'chroma_storage_corrupt' else 'chroma_runtime_error' end as error_code,
  case event_type when 'error' then 'chroma_storage_error' when 'click' then 'chroma_query_error'
    when 'view' then 'chroma_sqlite_compatibility' when 'signup' then 'chroma_storage_error'
    else 'chroma_runtime_error' end as error_type from events)
select error_code, error_type, case error_code when 'chroma_sqlite_incompatible' then 503
    when 'chroma_embedding_dimension_mismatch' then 422 when 'chroma_storage_corrupt' then 503 else 500 end as status_code,
  case error_code when 'chroma_sqlite_incompatible' then 'chroma/sqlite compatibility issue'
    when 'chroma_embedding_dimension_mismatch' then 'embedding dimension mismatch'
    when 'chroma_storage_corrupt' then 'local embeddings store unavailable' else 'retrieval failed' end as error_summary,
  count(*) as rows from c group by all""")
def _(spark, d):
    kind = F.col("event_type")
    text = F.lit("other trouble ")
    for name, words in MESSAGES.items():
        text = F.when(kind == name, words).otherwise(text)
    failed = tables.table(spark, d, "events").select(F.concat(text, "props").alias("message"))
    return requests.error_counts(requests.classify_errors(failed))


@query("page_assembly", """select conv_id, string_agg(text || chr(10), '' order by turn) as text from conversations group by 1""")
def _(spark, d):
    return context.assemble_pages(tables.table(spark, d, "conversations"), "conv_id", "turn", "text", sheet=4)


@query("rebuilt_abstracts", f"""select doc_id, array_to_string({q.words('text')}, ' ') as abstract from documents
where len({q.words('text')}) > 0""")
def _(spark, d):
    docs = tables.table(spark, d, "documents")
    # a fixed number of partitions, as the work behind this shuffle is far larger than its bytes
    dealt = docs.select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    texts = dealt.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    inverted = texts.select("doc_id", tx.inverted_words(F.col("texts")).alias("m")).where(F.size("m") > 0)
    return inverted.select("doc_id", tx.rebuild_abstract(F.col("m")).alias("abstract"))


@query("unit_values", """select event_id, round(value * 100, 2) as match_percentage, round(1 - value, 4) as similarity,
  round(0.6::DOUBLE * value + 0.4::DOUBLE * (1 - value), 3) as confidence, strftime(ts, '%Y%m%d_%H%M%S') as stamp from events""")
def _(spark, d):
    v = F.col("value")
    return tables.table(spark, d, "events").select(
        "event_id", sc.percent(v).alias("match_percentage"),
        F.round(sc.similarity_from_distance(v), 4).alias("similarity"),
        sc.confidence(v, 1 - v).alias("confidence"), sc.stage_stamp(F.col("ts")).alias("stamp"))

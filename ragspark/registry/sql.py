"""SQL fragments (DuckDB dialect) shared by the reference statements of the registered queries."""

from __future__ import annotations

from ragspark.functions import fixed_values as fv

WORD = r"[\p{L}\p{N}_]+"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}')"


def estimate(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{WORD}'))"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def keywords(x: str) -> str:
    """Distinct keywords in order of first appearance."""
    kept = f"list_filter({tokens(x)}, lambda t: length(t) > 2 and t not in ({quoted(fv.STOP_WORDS)}))"
    return ordered_distinct(kept)


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def hits(text: str, kws: str) -> str:
    count = f"(length(lower({text})) - length(replace(lower({text}), k, ''))) // length(k)"
    return f"coalesce(list_sum(list_transform({kws}, lambda k: {count})), 0)::BIGINT"


def pronouns(x: str) -> str:
    t = tokens(x)
    return (f"case when len({t}) = 0 then 0.0 else "
            f"len(list_filter({t}, lambda t: t in ({quoted(fv.PRONOUNS)})))::DOUBLE / len({t}) end")


def structure(x: str) -> str:
    return (rf"(contains({x}, chr(10) || chr(10)) or regexp_matches({x}, '(?m)^\s*[-•*]\s+') "
            rf"or regexp_matches({x}, '\n[A-Z][A-Za-z\s]{{3,}}\n'))")


def forum_source(x: str) -> str:
    return f"({' or '.join(f'contains({x}, {quoted([s])})' for s in fv.FORUM_SITES)})"


def noise(x: str) -> str:
    return f"({' or '.join(f'contains(lower({x}), {quoted([s])})' for s in fv.FORUM_MARKERS)})"


def code_share(x: str) -> str:
    """Share of non-blank lines that look like code, 0 without lines."""
    lines = rf"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"
    edge = r"[^\p{L}\p{N}_]"
    loops = rf"(^|{edge})(for|while)($|{edge})|(^|{edge})if($|{edge}.*:|:)|=>"
    test = (r"starts_with(l, 'def ') or starts_with(l, 'class ') or starts_with(l, 'function ') "
            r"or contains(l, '{') or contains(l, '}') or starts_with(l, '#') or starts_with(l, '//') "
            rf"or contains(l, '();') or regexp_matches(l, '{loops}')")
    return f"coalesce(len(list_filter({lines}, lambda l: {test}))::DOUBLE / nullif(len({lines}), 0), 0.0)"


def penalty(x: str) -> str:
    return f"len(list_filter([{quoted(fv.PENALTY_PHRASES)}], lambda p: contains(lower({x}), p))) * 0.5::DOUBLE"


def clean(x: str) -> str:
    out = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    out = rf"regexp_replace({out}, '\n\s*\n', chr(10), 'g')"
    out = rf"array_to_string(list_transform(string_split({out}, chr(10)), lambda l: {strip('l')}), chr(10))"
    out = rf"regexp_replace({out}, '\s+([.,!?;:])', '\1', 'g')"
    out = rf"regexp_replace({out}, '[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]', '', 'g')"
    return strip(out)


def lexical(query: str, text: str) -> str:
    """Saturating count of the query's keywords among the text's tokens."""
    n = f"len(list_filter({tokens(text)}, lambda t: t = k))"
    return f"coalesce(list_sum(list_transform({keywords(query)}, lambda k: {n} * 2.5::DOUBLE / ({n} + 1.5::DOUBLE))), 0.0)"


def cosine(a: str, b: str) -> str:
    return (f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) "
            f"* sqrt(list_dot_product({b}, {b})), 0), 0.0)")


def hashed(source: str, key: str, text: str, dim: int = 64) -> str:
    """Statement for ``(key, v)``: unit vectors of hashed word counts."""
    return f"""
    select k.key as {key}, list(coalesce(c.n, 0) / nullif(k.len, 0) order by k.slot) as v
    from (select b.key, s.slot, b.len from (
            select d.{key} as key, sqrt(coalesce(sum(h.n * h.n), 0)) as len
            from {source} d left join (select {key}, slot, count(*)::DOUBLE as n from _slots_{key} group by all) h
              on h.{key} = d.{key} group by 1) b, (select unnest(range({dim})) as slot) s) k
    left join (select {key}, slot, count(*)::DOUBLE as n from _slots_{key} group by all) c
      on c.{key} = k.key and c.slot = k.slot
    group by 1"""


def slots(source: str, key: str, text: str, dim: int = 64) -> str:
    """Statement for one row per word occurrence: ``(key, slot)``."""
    return f"""
    select {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} as slot
    from (select {key}, unnest({tokens(text)}) as w from {source})"""


QUERIES = "queries as (select item_id as query_id, text as query from benchmark)"

WEB = QUERIES + """,
web_base as (
  select doc_id, doc_id % (select count(*) from benchmark) as query_id,
         (doc_id // (select count(*) from benchmark))::INT as pos,
         'https://' || case when source = 'src11' then 'stackoverflow.com' else source || '.example.com' end
           || '/' || doc_id as url,
         (doc_id * 37 % 100) / 100.0::DOUBLE as score, text as c0
  from documents),
web1 as (select * replace (case when doc_id % 3 = 0 then replace(c0, chr(10), chr(10) || chr(10)) else c0 end as c0)
         from web_base),
web2 as (select * replace (case when doc_id % 5 = 0 then '- ' || c0 else c0 end as c0) from web1),
web3 as (select * replace (case when doc_id % 7 = 0 then c0 || ' you we your our' else c0 end as c0) from web2),
web4 as (select * replace (case when doc_id % 11 = 0 then c0 || ' What is the best? Pros and cons. Posted by' else c0 end
                           as c0) from web3),
web5 as (select * replace (case when doc_id % 13 = 0 then c0 || chr(10) || 'def f():' || chr(10) || '{' || chr(10)
                           || '}' || chr(10) || '// x' else c0 end as c0) from web4),
web as (select w.doc_id, w.query_id, w.pos, w.url, w.score, w.c0 as content, q.query
        from web5 w join queries q using (query_id))"""

SIGNALS = f"""{WEB},
signals as (select *, {hits('content', keywords('query'))} as keyword_hits, {pronouns('content')} as pronoun_ratio,
                   {structure('content')} as has_structure, length({strip('content')}) as content_chars from web)"""

VALID = ("score >= 0.6 and content_chars >= 800 and has_structure and keyword_hits >= 1 and pronoun_ratio <= 0.02")

FILTERED = f"""{SIGNALS},
kept as (select * from signals where {VALID}),
filtered as (select * from kept union all
             select * from signals where pos < 3 and query_id not in (select query_id from kept))"""

CONTEXT_CHUNKS = f"""{WEB},
chunks as (select query_id, pos + 1 as rank, url as source, content as chunk_text,
                  {estimate('content')}::INT as token_estimate,
                  (doc_id * 7919 % 1000) / 100.0::DOUBLE as rerank_score, score as similarity from web),
flags as (select *, {forum_source('source')} as is_forum, {noise('chunk_text')} as is_noise,
                 {code_share('chunk_text')} >= 0.35 as is_code from chunks)"""

DECISION = """
decision as (
  select *, case when total_tokens > 900 or rows > 3 or mean_rerank < 4.5 or any_forum or any_noise or any_code
                 then 'compressed' else 'passthrough' end as mode
  from (select query_id, sum(token_estimate)::BIGINT as total_tokens, count(*) as rows,
               round(avg(coalesce(rerank_score, 0)), 6) as mean_rerank, bool_or(is_forum) as any_forum,
               bool_or(is_noise) as any_noise, bool_or(is_code) as any_code from flags group by 1))"""

FINAL_CONTEXT = f"""{DECISION},
clean_rows as (select f.* from flags f join decision d using (query_id)
               where d.mode = 'compressed' and not is_forum and not is_noise),
strong as (select * from clean_rows where rerank_score >= 4.5),
candidates as (select * from strong union all
               select * from clean_rows where query_id not in (select query_id from strong)),
running as (select *, sum(token_estimate) over (partition by query_id order by rerank_score desc, rank) as used
            from candidates),
picked as (select * exclude (used) from running where used <= 900 union all
           select f.* from flags f join decision d using (query_id) where d.mode = 'passthrough'),
final_context as (
  select p.query_id, d.mode, row_number() over (partition by p.query_id order by rank)::INT as block,
         chunk_text as text, source, round(0.6::DOUBLE * rerank_score + 0.4::DOUBLE * similarity, 3) as confidence
  from picked p join decision d using (query_id))"""

PASSAGES = """passage_queries as (
  select vec_id as query_id, 'book-' || label as book_uid, list_reverse(embedding)::DOUBLE[] as v from embeddings),
collections as (
  select 'book-' || label as book_uid, vec_id as chunk_id, 'passage ' || vec_id as document, embedding::DOUBLE[] as v
  from embeddings)"""

BOOKS = """books as (
  select p_partkey::INT as id, case when p_partkey % 4 = 0 then 'lib-' else 'book-' end || p_partkey as uid,
         p_name as title, p_brand as author, case when p_partkey % 10 <> 0 then 'isbn-' || p_partkey end as isbn,
         p_type as topic, p_name || ', ' || p_type as description, null::VARCHAR as cover_image_url,
         p_size + 1990 as published_year from part)"""

RECOMMENDER = """recommender as (
  select p_partkey as book_id, p_name as title, p_brand as author, p_type as category,
         p_type || ' ' || p_name || ' in size ' || p_size as summary,
         case p_size % 3 when 0 then true when 1 then false end as processed from part),
questions as (
  select n_nationkey::BIGINT as query_id, 'Brand#1 ' || string_split(n_name, '_')[2] || ' red  bolt nat' as query
  from nation union all
  select s_suppkey + 1000, 'small WIDGET ' || s_nationkey || ' economy' from supplier)"""

PAPERS = """papers as (
  select doc_id as paper_id, string_split(text, chr(10))[1] as title,
         case doc_id % 4 when 0 then '10.1/' || doc_id || ' x' when 1 then 'https://id.example.org/' || doc_id
                         when 2 then 'S' || doc_id end as doi,
         (doc_id % 40 + 1980)::INT as year, text as abstract, (doc_id * 7919 % 500)::INT as citations,
         ['IEEE', 'Elsevier', 'Springer Nature', 'MIT Press', ''][doc_id % 5 + 1] as publisher,
         doc_id % 3 = 0 as is_oa, case when doc_id % 6 = 0 then 'https://pdf.example.org/' || doc_id end as pdf
  from documents),
candidates_ as (select paper_id % (select count(*) from benchmark) as query_id,
                       (paper_id // (select count(*) from benchmark))::INT as pos, * from papers)"""

LINES = """lines as (
  select source as book_uid, case when line % 50 <> 49 then doc_id * 100000 + line end as chunk_id, text
  from (select source, doc_id, unnest(string_split(text, chr(10))) as text,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents))"""


def bm25(corpus: str, key: str, text: str, asked: str, k: int, full: bool = False) -> str:
    """Tables ``bm25_*`` ending in ``bm25_hits(query_id, key, score, rank)``; ``full`` ranks documents without a match too."""
    every = (f"(select a.query_id, d.{key}, coalesce(s.score, 0.0::DOUBLE) as score from {asked} a cross join {corpus} d "
             f"left join bm25_scores s on s.query_id = a.query_id and s.{key} = d.{key})")
    return f"""
bm25_tokens as (select {key}, unnest({words(text)}) as term from {corpus}),
bm25_lengths as (select {key}, len({words(text)}) as doc_len from {corpus}),
bm25_numbers as (select count(*)::DOUBLE as n, avg(doc_len) as mean_length from bm25_lengths),
bm25_tf as (select {key}, term, count(*) as tf from bm25_tokens group by all),
bm25_terms as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as idf
               from bm25_tf, bm25_numbers group by 1),
bm25_weights as (select term, case when idf < 0 then 0.25::DOUBLE * (select avg(idf) from bm25_terms) else idf end as idf
                 from bm25_terms),
bm25_asked as (select query_id, unnest({words('query')}) as term from {asked}),
bm25_scores as (
  select a.query_id, t.{key}, round(sum(w.idf * t.tf * 2.5::DOUBLE
           / (t.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.doc_len / c.mean_length))), 9) as score
  from bm25_asked a join bm25_tf t using (term) join bm25_weights w using (term) join bm25_lengths l using ({key}),
       bm25_numbers c group by 1, 2),
bm25_hits as (select * from (select *, row_number() over (partition by query_id order by score desc, {key})::INT as rank
                             from {every if full else 'bm25_scores'}) where rank <= {k})"""


def character_split(source: str) -> str:
    """Common table expressions from ``source`` (doc, text) to ``split_chunks`` (doc, chunk_id, text).

    Pieces are cut level by level; the chunks of a run are a walk over piece starts, each with its last piece and the
    start of the next chunk.
    """
    size, overlap = fv.SPLIT_SIZE, fv.SPLIT_OVERLAP
    levels = [f"split_0 as (select doc, 0::BIGINT as s, text as p, '' as run from {source} where {strip('text')} <> '')"]
    cuts = [sep for sep in fv.SPLIT_SEPARATORS if sep]
    for k, sep in enumerate(cuts, 1):
        literal = "'" + sep.replace("\n", "' || chr(10) || '") + "'"
        levels.append(f"""cut_{k} as (select doc, s as parent, i, case when i = 1 then part else {literal} || part end as p
  from (select doc, s, unnest(parts) as part, generate_subscripts(parts, 1) as i
        from (select doc, s, string_split(p, {literal}) as parts from split_{k - 1} where length(p) >= {size}))),
split_{k} as (select doc, (parent + sum(length(p)) over w - length(p))::BIGINT as s, p,
    '{k}:' || parent || ':' || sum((length(p) >= {size})::INT) over w as run
  from cut_{k} where p <> '' window w as (partition by doc, parent order by i))""")
    every = " union all ".join(f"select * from split_{k} where length(p) < {size}" for k in range(len(cuts) + 1))
    return ",\n".join(levels) + f""",
settled as (select doc, run, s, s + length(p) as e from ({every})),
numbered as (select *, greatest(lead(s) over w - {overlap}, lead(e) over w - {size}) as bound
  from settled window w as (partition by doc, run order by s)),
hops as (select a.doc, a.run, a.s, b.e as upto, b.bound from numbered a
  asof join numbered b on a.doc = b.doc and a.run = b.run and a.s + {size} >= b.e),
jumps as (select h.doc, h.run, h.s, h.upto, n.s as onward from hops h
  asof left join numbered n on h.doc = n.doc and h.run = n.run and h.bound <= n.s),
walk as (select doc, run, min(s) as s from numbered group by all
  union all select j.doc, j.run, j.onward from walk w join jumps j on j.doc = w.doc and j.run = w.run and j.s = w.s
  where j.onward is not null),
ranges as (select j.doc, j.s, j.upto from walk w join jumps j on j.doc = w.doc and j.run = w.run and j.s = w.s
  union all select doc, s + cut, s + least(cut + {size}, length(p))
  from (select doc, s, p, unnest(range(0, length(p) - {overlap}, {size - overlap})) as cut
        from split_{len(cuts)} where length(p) >= {size})),
range_texts as (select r.doc, r.s, {strip('substring(t.text, r.s + 1, r.upto - r.s)')} as text
  from ranges r join {source} t on t.doc = r.doc),
split_chunks as (select doc, row_number() over (partition by doc order by s)::INT - 1 as chunk_id, text
  from range_texts where length(text) > {fv.MIN_SPLIT_CHARS})"""

"""Chunkers. The window chunker is a fold over a document's blocks written as one SQL expression, so a document
is chunked inside its own row: no shuffle, no Python. The character splitter is a fold as well, over pieces that are
cut by one separator after another."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions import text as tx
from ragspark.session import cut_lineage

_CHUNK = "struct<text:string,tok:int>"
_BLOCK = "struct<text:string,tok:int,upto:int>"
_WORD = "'" + tx.WORD.replace("\\", "\\\\") + "'"
_SPACE = "'" + (tx.SPACE + "+").replace("\\", "\\\\") + "'"

SEGMENT = 64
RUN_SLICE = 65_536  # positions of a query that one task puts in order


def _fold(kind: str, carried: dict[str, str], merge: str, finish: str) -> str:
    """SQL of a fold over ``{items}`` that appends elements of ``kind`` to ``s.done`` and carries the state ``carried``.

    Appending copies an array, so the items are folded in segments, each with an empty ``done`` at its start; the
    segments' outputs are put together once. ``merge`` sees the item as ``b``; ``finish`` sees all output as ``done``
    and the last state as ``o``. Binding the items in a lambda keeps Spark from computing them once per segment.
    """
    def state(owner: str) -> str:
        return ", ".join(f"'{name}', {owner}.{name}" for name in carried)

    start = ", ".join(f"'{name}', {value}" for name, value in carried.items())
    return f"""
get(transform(array({{items}}), every -> aggregate(
  transform(sequence(0, cast((size(every) - 1) div {SEGMENT} as int)), i -> slice(every, i * {SEGMENT} + 1, {SEGMENT})),
  named_struct('parts', cast(array() as array<array<{kind}>>), {start}),
  (o, segment) -> get(transform(
    array(aggregate(segment, named_struct('done', cast(array() as array<{kind}>), {state('o')}), (s, b) -> {merge})),
    s -> named_struct('parts', concat(o.parts, array(s.done)), {state('s')})), 0),
  o -> get(transform(array(flatten(o.parts)), done -> {finish}), 0))), 0)
"""


# A block over the maximum is split once, cut every so many whitespace words and emitted at once.
_PIECES = f"""
get(transform(array(split(b.text, {_SPACE})), words -> transform(
  sequence(0, cast((size(words) - 1) div {fv.CHUNK_MAX_TOKENS} as int)),
  i -> get(transform(
    array(array_join(slice(words, i * {fv.CHUNK_MAX_TOKENS} + 1, {fv.CHUNK_MAX_TOKENS}), ' ')),
    piece -> named_struct('text', piece, 'tok', regexp_count(piece, {_WORD}))), 0))), 0)
"""

# State: done = emitted chunks; win = blocks of the open window, each with the running total up to and including it;
# base = running total before the window; total = running total of all blocks that entered a window.
_WINDOWS = _fold(_CHUNK, {"win": f"cast(array() as array<{_BLOCK}>)", "base": "0", "total": "0"}, f"""
  case
    when b.tok > {fv.CHUNK_MAX_TOKENS} then
      named_struct('done', concat(s.done, {_PIECES}), 'win', s.win, 'base', s.base, 'total', s.total)
    when s.total - s.base + b.tok <= {fv.CHUNK_MAX_TOKENS} then
      named_struct('done', s.done,
                   'win', concat(s.win, array(named_struct('text', b.text, 'tok', b.tok, 'upto', s.total + b.tok))),
                   'base', s.base, 'total', s.total + b.tok)
    else get(transform(
      array(filter(s.win, x -> s.total - x.upto < {fv.CHUNK_OVERLAP_TOKENS})),
      tail -> named_struct(
        'done', if(s.total - s.base >= {fv.CHUNK_MIN_TOKENS},
                   concat(s.done, array(named_struct('text', array_join(s.win.text, '\\n\\n'),
                                                     'tok', s.total - s.base))),
                   s.done),
        'win', concat(tail, array(named_struct('text', b.text, 'tok', b.tok, 'upto', s.total + b.tok))),
        'base', get(tail, 0).upto - get(tail, 0).tok,
        'total', s.total + b.tok)), 0)
  end""", f"""
  case
    when size(o.win) = 0 then done
    when o.total - o.base < {fv.CHUNK_MIN_TOKENS} and size(done) > 0
         and get(done, size(done) - 1).tok + o.total - o.base <= {fv.CHUNK_MERGE_LIMIT} then
      concat(slice(done, 1, size(done) - 1),
             array(named_struct(
               'text', concat(get(done, size(done) - 1).text, '\\n\\n', array_join(o.win.text, '\\n\\n')),
               'tok', get(done, size(done) - 1).tok + o.total - o.base)))
    else concat(done, array(named_struct('text', array_join(o.win.text, '\\n\\n'), 'tok', o.total - o.base)))
  end""")

# State: done = settled chunks; last = the chunk before the next one, still open to small successors; held = a small
# chunk that did not fit its predecessor and waits for the next one.
_PART = "struct<text:string,tok:int,section:int>"
_NO_PART = f"cast(array() as array<{_PART}>)"
_MERGE = _fold(_PART, {"last": _NO_PART, "held": _NO_PART}, f"""
  case
    when size(s.held) > 0 and get(s.held, 0).tok + b.tok <= {fv.CHUNK_MERGE_LIMIT} then
      named_struct('done', concat(s.done, s.last),
                   'last', array(named_struct('text', concat(get(s.held, 0).text, '\\n\\n', b.text),
                                              'tok', get(s.held, 0).tok + b.tok, 'section', get(s.held, 0).section)),
                   'held', slice(s.held, 1, 0))
    when size(s.held) > 0 then
      named_struct('done', concat(s.done, s.last, s.held), 'last', array(b), 'held', slice(s.held, 1, 0))
    when b.tok < {fv.CHUNK_MIN_TOKENS} and size(s.last) > 0
         and get(s.last, 0).tok + b.tok <= {fv.CHUNK_MERGE_LIMIT} then
      named_struct('done', s.done,
                   'last', array(named_struct('text', concat(get(s.last, 0).text, '\\n\\n', b.text),
                                              'tok', get(s.last, 0).tok + b.tok, 'section', get(s.last, 0).section)),
                   'held', s.held)
    when b.tok < {fv.CHUNK_MIN_TOKENS} then named_struct('done', s.done, 'last', s.last, 'held', array(b))
    else named_struct('done', concat(s.done, s.last), 'last', array(b), 'held', s.held)
  end""", "concat(done, o.last, o.held)")


def text_blocks(df: DataFrame, text: str, out: str = "blocks") -> DataFrame:
    """Sentence blocks of a text column with their token counts; blocks without a word are left out."""
    counted = F.transform(
        tx.sentence_blocks(F.col(text)), lambda b: F.struct(b.alias("text"), tx.token_estimate(b).alias("tok"))
    )
    return df.withColumn(out, F.filter(counted, lambda b: b["tok"] > 0))


def window_chunks(df: DataFrame, text: str, out: str = "chunks") -> DataFrame:
    """Adds ``out``: overlapping chunks of 200-300 tokens as ``array<struct<text,tok,section>>``."""
    folded = text_blocks(df, text, "_blocks").withColumn("_raw", F.expr(_WINDOWS.replace("{items}", "_blocks")))
    numbered = F.transform(
        F.col("_raw"),
        lambda c, i: F.struct(c["text"].alias("text"), c["tok"].alias("tok"), i.alias("section")),
    )
    return folded.withColumn(out, numbered).drop("_blocks", "_raw")


def merge_small(df: DataFrame, chunks: str = "chunks") -> DataFrame:
    """Joins chunks below the minimum to their predecessor, else to their successor, within one array."""
    return df.withColumn(chunks, F.expr(_MERGE.replace("{items}", chunks)))


def exploded(df: DataFrame, keep: list[str], array: Column, position: str, value: str) -> DataFrame:
    """``posexplode`` of an expensive array. The outer form keeps Spark from inferring a filter on the array, which
    would compute the array a second time below the generator."""
    return df.select(*keep, F.posexplode_outer(array).alias(position, value)).where(F.col(position).isNotNull())


def _one_row_per_chunk(df: DataFrame, keep: list[str]) -> DataFrame:
    return exploded(df, keep, F.col("chunks"), "part", "c").select(
        *keep,
        "part",
        F.col("c.section").alias("section_index"),
        F.col("c.text").alias("chunk_text"),
        F.col("c.tok").alias("token_estimate"),
    )


def chunk_results(results: DataFrame, merge: bool = True) -> DataFrame:
    """Chunks of filtered web results ``(query_id, pos, url, score, content)``, with positions unique in a query.

    Small neighbours merge within one source. Nearly always that is one result row, folded inside the row; rows that
    stand beside another row of their query and source merge across rows (``_merge_runs``). ``part`` orders the chunks
    of a result; across rows, a merged chunk has place, score and section of its first member.
    """
    keyed = results.select("query_id", "pos", F.col("url").alias("source"), F.col("score").alias("tavily_score"),
                           "content")
    keep = ["query_id", "pos", "source", "tavily_score"]
    if not merge:
        return _one_row_per_chunk(window_chunks(keyed, "content").drop("content"), keep)
    narrow = cut_lineage(keyed.select("query_id", "pos", "source"))  # read several times; its filters run once
    runs = cut_lineage(_neighbours(narrow))
    alone = keyed.join(runs, ["query_id", "pos"], "left_anti")
    beside = window_chunks(keyed.join(runs, ["query_id", "pos"]), "content").drop("content")
    return _one_row_per_chunk(merge_small(window_chunks(alone, "content").drop("content")), keep).unionByName(
        _merge_runs(_one_row_per_chunk(beside, [*keep, "run"])))


def _neighbours(rows: DataFrame) -> DataFrame:
    """``(query_id, pos, run)`` of rows beside a row of their query and source; ``run`` is the first row's position.

    Rows are narrow and ordered in slices of ``RUN_SLICE`` positions, so a query of any length is many groups; the
    slices' edges, one row each, link the slices of a query. A row without words still parts its neighbours.
    """
    sliced = rows.withColumn("_slice", F.floor(F.col("pos") / RUN_SLICE))
    inside = Window.partitionBy("query_id", "_slice").orderBy("pos")
    across = Window.partitionBy("query_id").orderBy("_slice")
    ends = sliced.groupBy("query_id", "_slice").agg(
        F.max_by(F.struct("source"), "pos").alias("_end"), F.min_by(F.struct("source"), "pos").alias("_begin"))
    edges = ends.select(
        "query_id", "_slice", F.lag("_end").over(across).alias("_end"), F.lead("_begin").over(across).alias("_begin"))
    source = F.struct("source")
    linked = sliced.join(edges, ["query_id", "_slice"]).select(
        "query_id", "pos", "_slice",
        F.coalesce(F.lag(source).over(inside), F.col("_end")).eqNullSafe(source).alias("_after"),
        F.coalesce(F.lead(source).over(inside), F.col("_begin")).eqNullSafe(source).alias("_before"))
    members = linked.where("_after or _before")
    start = F.when(~F.col("_after"), F.col("pos"))
    opened = members.groupBy("query_id", "_slice").agg(F.max(start).alias("_open"))
    carried = opened.select("query_id", "_slice", F.max("_open").over(
        across.rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))
    run = F.coalesce(F.max(start).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_open"))
    return members.join(carried, ["query_id", "_slice"]).select("query_id", "pos", run.alias("run"))


def _merge_runs(chunks: DataFrame) -> DataFrame:
    """Joins small chunks to their predecessor, else to their successor, over all rows of a run.

    Each task reads its runs in order and holds one or two chunks, so a run may have any length.
    """
    rows = chunks.select("query_id", "run", "pos", "part", "source", "tavily_score", "section_index", "chunk_text",
                         "token_estimate")

    def merged(first: dict, second: dict) -> dict:
        return first | {"chunk_text": first["chunk_text"] + "\n\n" + second["chunk_text"],
                        "token_estimate": first["token_estimate"] + second["token_estimate"]}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held = None
        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                if last is not None or held is not None:
                    before = held or last
                    if (before["query_id"], before["run"]) != (row["query_id"], row["run"]):
                        ready += [c for c in (last, held) if c is not None]
                        last = held = None
                small = row["token_estimate"] < fv.CHUNK_MIN_TOKENS
                if held is not None:
                    fits = held["token_estimate"] + row["token_estimate"] <= fv.CHUNK_MERGE_LIMIT
                    ready += [c for c in ((last,) if fits else (last, held)) if c is not None]
                    last, held, small = (merged(held, row), None, None) if fits else (None, None, small)
                    if fits:
                        continue
                if small and last is not None and last["token_estimate"] + row["token_estimate"] <= fv.CHUNK_MERGE_LIMIT:
                    last = merged(last, row)
                elif small:
                    held = row
                else:
                    ready += [last] if last is not None else []
                    last = row
            yield pa.RecordBatch.from_pylist(ready, schema=batch.schema)
            kind = batch.schema
        rest = [c for c in (last, held) if c is not None]
        if rest:
            yield pa.RecordBatch.from_pylist(rest, schema=kind)

    ordered = rows.repartition("query_id", "run").sortWithinPartitions("query_id", "run", "pos", "part")
    return ordered.mapInArrow(fold, rows.schema).drop("run")


# Recursive character split, one level of separators after another. An item is a piece of the text with its length;
# ``starts`` marks an item that may not share a chunk with the one before it: they have different parents, or a piece
# that was cut further lies between them.
_RANGE = "struct<a:int,b:int>"


def _finer(items: str, cut: str) -> str:
    """SQL of the items with every one that fills a whole chunk replaced by the items of ``cut``."""
    return f"flatten(transform({items}, x -> if(x.n >= {fv.SPLIT_SIZE}, {cut}, array(x))))"


def _cut_at(separator: str) -> str:
    """Pieces of ``x.p``; each but the first begins with the separator that was found before it."""
    literal = separator.replace("\n", "\\n")
    return f"""get(transform(
      array(filter(transform(split(x.p, '{literal.replace(".", "[.]")}', -1), (y, i) -> if(i = 0, y, concat('{literal}', y))),
                   y -> y != '')),
      ps -> transform(ps, (y, i) -> named_struct(
        'p', y, 'n', length(y), 'starts', i = 0 or length(get(ps, i - 1)) >= {fv.SPLIT_SIZE}))), 0)"""


# Text without any separator: one pass cuts it by the stride, and each window takes its overlap from the next cut.
_STRIDE = fv.SPLIT_SIZE - fv.SPLIT_OVERLAP
_CUT_BY_LENGTH = f"""get(transform(
      array(regexp_extract_all(x.p, '(?s).{{{{1,{_STRIDE}}}}}', 0)),
      ps -> filter(
        transform(ps, (y, i) -> get(transform(
          array(concat(y, coalesce(substring(get(ps, i + 1), 1, {fv.SPLIT_OVERLAP}), ''))),
          w -> named_struct('p', w, 'n', length(w), 'starts', true)), 0)),
        (w, i) -> i = 0 or w.n > {fv.SPLIT_OVERLAP})), 0)"""


def _split_items(text: str) -> str:
    items = f"array(named_struct('p', {text}, 'n', length({text}), 'starts', true))"
    for separator in fv.SPLIT_SEPARATORS:
        items = _finer(items, _cut_at(separator) if separator else _CUT_BY_LENGTH.format())
    return items


# State: done = index ranges of the chunks put out; a = first item of the open chunk, len = its length, i = items seen.
# A full chunk hands on its last items, as many as fit the overlap and leave room for the next item.
_PACK = _fold(_RANGE, {"a": "0", "len": "0", "i": "0"}, f"""
  case
    when b.starts then
      named_struct('done', if(s.a > 0, concat(s.done, array(named_struct('a', s.a, 'b', s.i))), s.done),
                   'a', s.i + 1, 'len', b.n, 'i', s.i + 1)
    when s.len + b.n > {fv.SPLIT_SIZE} then get(transform(
      array(aggregate(
        reverse(slice(every, greatest(s.i - {fv.SPLIT_OVERLAP} + 1, 1), least(s.i, {fv.SPLIT_OVERLAP}))),
        named_struct('m', 0, 'len', 0, 'open', true),
        (k, x) -> if(k.open and k.len + x.n <= {fv.SPLIT_OVERLAP} and k.len + x.n + b.n <= {fv.SPLIT_SIZE},
                     named_struct('m', k.m + 1, 'len', k.len + x.n, 'open', true),
                     named_struct('m', k.m, 'len', k.len, 'open', false)))),
      k -> named_struct('done', concat(s.done, array(named_struct('a', s.a, 'b', s.i))),
                        'a', s.i + 1 - k.m, 'len', k.len + b.n, 'i', s.i + 1)), 0)
    else named_struct('done', s.done, 'a', s.a, 'len', s.len + b.n, 'i', s.i + 1)
  end""", """
  transform(concat(done, array(named_struct('a', o.a, 'b', o.i))),
            r -> array_join(transform(slice(every, r.a, r.b - r.a + 1), x -> x.p), ''))""")


def split_characters(text: str) -> Column:
    """Recursive character split of a text column: 480 characters, 100 overlap, coarse separators first.

    One SQL expression, linear in the text's length. Null and blank texts have no chunks.
    """
    kept = F.when(tx.filled(F.col(text)).isNotNull(), F.expr(_PACK.format(items=_split_items(f"`{text}`"))))
    return F.filter(F.transform(F.coalesce(kept, F.array().cast("array<string>")), tx.strip), lambda c: c != "")


def long_enough(chunks: Column) -> Column:
    """Stripped chunks of more than 20 characters."""
    return F.filter(F.transform(chunks, tx.strip), lambda c: F.length(c) > fv.MIN_SPLIT_CHARS)


def split_book(books: DataFrame) -> DataFrame:
    """Book chunks ``(book_uid, chunk_id, text, length, word_count, char_count)`` from ``(book_uid, text)``."""
    parts = exploded(books, ["book_uid"], long_enough(split_characters("text")), "chunk_id", "text")
    return chunk_metadata(parts)


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "book_uid",
        "chunk_id",
        "text",
        F.length("text").alias("length"),
        tx.word_count(F.col("text")).alias("word_count"),
        F.length("text").alias("char_count"),
    )


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Count, mean length and words, shortest and longest chunk per book; partial sums before the shuffle."""
    return chunks.groupBy("book_uid").agg(
        F.count("*").alias("total_chunks"),
        F.round(F.avg("length"), 6).alias("mean_length"),
        F.round(F.avg("word_count"), 6).alias("mean_words"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
    )

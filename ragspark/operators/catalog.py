"""Library catalog: search, listing, point lookup and canonical merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.operators.dedupe import first_seen
from ragspark.operators.pages import numbered
from ragspark.operators.ranking import page_bounds, paginate
from ragspark.session import cut_lineage
from ragspark.sources.versions import read_current, replace_table

SEARCHED = ["title", "author", "isbn", "topic"]
PAYLOAD = ["uid", "title", "author", "isbn", "topic", "description", "cover_image_url", "published_year"]


def search(books: DataFrame, term: str | None) -> DataFrame:
    """Case-insensitive containment in title, author, isbn or topic; ``%`` and ``_`` keep their pattern meaning."""
    if not term or not term.strip():
        return books
    pattern = f"%{term.strip()}%"
    return books.where(reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in SEARCHED]))


def api_view(books: DataFrame) -> DataFrame:
    return books.select(
        "id", "uid", "title", "author", "isbn", "topic", "description",
        F.col("cover_image_url").alias("coverImageUrl"), F.col("published_year").alias("publishedYear"))


def total(books: DataFrame) -> DataFrame:
    """One row with the number of matches, whatever the page."""
    return books.agg(F.count("*").alias("total"))


def list_books(books: DataFrame, term: str | None = None, page=1, size=20) -> DataFrame:
    """One page of matches by title, each row with the total number of matches, which is counted first."""
    number, length = page_bounds(page, size)
    found = search(books, term)
    shown = api_view(paginate(found, ["title", "id"], page, size))
    return shown.withColumns({
        "page": F.lit(number), "page_size": F.lit(length), "total": F.lit(found.count()).cast("bigint")})


def lookup(refs: DataFrame, books: DataFrame) -> DataFrame:
    """Book of each ``ref``: by uid, else, if the reference is all digits, by id."""
    by_uid = refs.join(books, refs["ref"] == books["uid"])
    left = refs.join(books.select(F.col("uid").alias("ref")), "ref", "left_anti")
    numbered = left.where(F.col("ref").rlike("^[0-9]+$")).withColumn("_id", F.col("ref").try_cast("int"))
    by_id = numbered.join(books, F.col("_id") == books["id"]).drop("_id")
    return by_uid.unionByName(by_id)


def merge_plan(existing: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row per book with its action: ``insert``, ``update``, ``unchanged``, ``delete`` or ``keep``.

    A canonical book matches the existing row with its uid, else the one with its isbn; of several rows with one isbn
    the last by id. A row that is claimed by its uid is not claimed by its isbn as well, and of several books that claim
    a row by its isbn the one with the least uid gets it; the others are inserted. Existing ``book-`` rows that no canonical
    book claims are deleted, other unclaimed rows are kept.
    """
    old = existing.select(*[F.col(c).alias(f"old_{c}") for c in ["id", *PAYLOAD]])
    new = canonical.select(*PAYLOAD)
    by_uid = new.join(old, F.col("uid") == F.col("old_uid"))
    rest = new.join(existing.select("uid"), "uid", "left_anti")
    free = first_seen(old.where("old_isbn <> ''"), ["old_isbn"], [F.desc("old_id")]).join(
        new.select(F.col("uid").alias("old_uid")), "old_uid", "left_anti").select(*old.columns)
    claims = first_seen(rest.where("isbn <> ''"), ["isbn"], [F.asc("uid")]).select(
        "isbn", F.col("uid").alias("claimant")).join(free, F.col("isbn") == F.col("old_isbn")).drop("isbn")
    by_isbn = rest.join(claims, F.col("uid") == F.col("claimant"), "left").drop("claimant").select(*by_uid.columns)
    matched = by_uid.unionByName(by_isbn)
    changed = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in PAYLOAD])
    claimed = matched.select(
        F.col("old_id").alias("id"),
        *PAYLOAD,
        F.when(F.col("old_uid").isNull(), "insert").when(changed, "update").otherwise("unchanged").alias("action"),
    )
    spare = existing.select("id", *PAYLOAD).join(
        matched.where(F.col("old_uid").isNotNull()).select(F.col("old_uid").alias("uid")), "uid", "left_anti")
    unclaimed = spare.select(
        "id", *PAYLOAD, F.when(F.col("uid").startswith("book-"), "delete").otherwise("keep").alias("action"))
    return claimed.unionByName(unclaimed)


def merge_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("rows"))


def merged(plan: DataFrame) -> DataFrame:
    """The catalog after the merge; inserted rows have no id until the sink gives them one."""
    return plan.where(F.col("action") != "delete").drop("action")


def write_merged(plan: DataFrame, path: str) -> DataFrame:
    """The merged catalog as the new version of the table at ``path``; inserted rows get the ids after the largest one.

    Ids follow the uids of the inserted rows, so a repeated write gives the same table.
    """
    whole = cut_lineage(merged(plan))
    highest = plan.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    kind = whole.schema["id"].dataType
    added = numbered(whole.where("id is null").drop("id"), ["uid"], highest + 1)
    held = whole.where("id is not null").unionByName(added.withColumn("id", F.col("id").cast(kind)))
    replace_table(held, path, whole.count())
    return read_current(plan.sparkSession, path)


def resolve_titles(rows: DataFrame, titles: DataFrame, key: str = "book_uid") -> DataFrame:
    """Display title per row, ``Unknown Title`` where there is none."""
    named = rows.join(titles.select(key, F.col("title").alias("_title")), key, "left")
    return named.withColumn("book_title", F.coalesce("_title", F.lit("Unknown Title"))).drop("_title")


def unprocessed(books: DataFrame) -> DataFrame:
    """Recommender rows still to be indexed; the filter reaches the file scan."""
    open_rows = books.where((F.col("processed") == F.lit(False)) | F.col("processed").isNull())
    return open_rows.select("book_id", "title", "author", "category", "summary").orderBy("book_id")


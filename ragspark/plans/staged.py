"""A flow run stage by stage. Every stage's table is kept with a manifest, so a run that died goes on where it stopped.

A stage writes a new version of its table beside the old one, and a pointer renamed at the end makes it current
(``sources.versions``); a stage that dies half way leaves nothing that a later run would read. The manifest inside a version
names its input: a digest of the rows for the first stage, the version of the stage before for all others. A stage is run
again when its input is not the one in its manifest, so new source rows or a repeated stage make all later tables stale.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.sources import versions

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def fingerprint(rows: DataFrame) -> str:
    """Columns, number of rows and a sum of row hashes, whatever the order; one pass with partial sums.

    Maps have no hash in Spark, so columns that hold one are hashed as their JSON text.
    """
    plain = [F.to_json(F.struct(c)) if "map<" in t else F.col(f"`{c}`") for c, t in rows.dtypes]
    place = F.xxhash64(*plain).cast("decimal(38,0)") if plain else F.lit(0).cast("decimal(38,0)")
    other = F.hash(*plain).cast("decimal(38,0)") if plain else F.lit(0).cast("decimal(38,0)")
    n, a, b = rows.agg(F.count("*"), F.sum(place), F.sum(other)).first()
    return f"{rows.schema.simpleString()} {n} {a} {b}"


def manifest(spark, folder: str, name: str) -> dict | None:
    """What the committed table of a stage was made from; nothing before its first commit."""
    version = versions.current_version(spark, f"{folder}/stage={name}")
    note = versions.note_of(spark, version) if version else None
    return None if note is None else {**json.loads(note), "version": version}


def run_stages(stages: list[Stage], source: DataFrame, folder: str, start: str | None = None,
               resume: bool = False) -> DataFrame:
    """Runs the stages in order and returns the last one's stored table.

    With ``resume``, a stage whose committed table was made from the present input is not run but read. With ``start``
    the run begins there, from the table that the stage before it committed.
    """
    spark = source.sparkSession
    names = [name for name, _ in stages]
    if len(set(names)) < len(names):
        raise ValueError("stage names must differ")
    first = 0 if start is None else names.index(start)
    if first:
        before = manifest(spark, folder, names[first - 1])
        if before is None:
            raise ValueError(f"stage {names[first - 1]} has no committed table to start from")
        current, made_from = spark.read.parquet(before["version"]), before["version"]
    else:
        current, made_from = source, fingerprint(source)
    for name, step in stages[first:]:
        kept = manifest(spark, folder, name) if resume else None
        if kept is not None and kept["input"] == made_from:
            made_from = kept["version"]
        else:
            note = json.dumps({"stage": name, "input": made_from})
            made_from = versions.replace_table(step(current), f"{folder}/stage={name}", note=note)
        current = spark.read.parquet(made_from)
    return current

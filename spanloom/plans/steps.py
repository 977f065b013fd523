"""An ordered list of steps over one state, as a configuration names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import detect, maps, resolve
from spanloom.sources import files, store

State = dict[str, DataFrame]


def read_step(state: State, options: dict) -> State:
    return state | {"docs": state["docs"].select("doc_id", "text")}


def detect_step(state: State, options: dict) -> State:
    """options: patterns, add, exclude, excluded_words (substrings, searches, exact), pages' chunks (delimiter, max_chars), predetected.

    Built-in patterns report whole matches, added ones what they capture; added spans displace built-in ones.  Rows that
    were detected before stay, and the first of rows with one entity and span wins.
    """
    found = detect.refine(detect.chunked(state["docs"], options.get("patterns", detect.PATTERNS), **options.get("chunks", {})))
    if good := detect.compile_patterns(options.get("add", [])):
        added = detect.added(state["docs"], good)
        found = detect.without_overlaps(found, added).unionByName(added)
    if words := options.get("excluded_words"):
        found = found.filter(~detect.excluded(F.col("word"), **words))
    found = numbered(detect.omit(found, state["docs"], options.get("exclude", [])))
    if options.get("predetected", True) and "found" in state:
        found = resolve.first_wins(resolve.merged(numbered(state["found"]), found), "doc_id", "entity", "start", "end")
    return state | {"found": found}


def numbered(found: DataFrame) -> DataFrame:
    """found with seq, its place in the document: by seq if it has one, else by prio, start and origin."""
    if "seq" in found.columns:
        return found.select("doc_id", "seq", "entity", "start", "end", "word", "origin")
    order = [c for c in ("start", "prio", "end", "entity", "origin", "word") if c in found.columns]
    rows = found.withColumn("seq", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)).cast("long"))
    return rows.select("doc_id", "seq", "entity", "start", "end", "word", "origin")


def ordered(found: DataFrame, *keys: str) -> DataFrame:
    """found with seq, its place in the document by the keys."""
    return found.withColumn("seq", F.row_number().over(W.partitionBy("doc_id").orderBy(*keys)).cast("long"))


def duplicate_step(state: State, options: dict) -> State:
    rows = numbered(state["found"]).select("doc_id", "seq", "entity", F.col("start").alias("gstart"), (F.col("end") - 1).alias("gend"), "word", "origin")
    best = resolve.resolve(rows, options.get("overlap", "overlap"), options.get("entities", "any"))
    return state | {"found": best.select("doc_id", F.col("comp").alias("seq"), "entity", F.col("gstart").alias("start"), (F.col("gend") + 1).alias("end"), "word", "origin")}


def mask_step(state: State, options: dict) -> State:
    return state | {"docs": detect.redact(state["docs"], state["found"], options.get("mark", "█"))}


def embed_step(state: State, options: dict) -> State:
    """Writes the state's maps (doc_id, offset2coordsMap) beside the files: options path, and force for files that have changed.

    A document without a map fails the job; with hashes (doc_id, expected, sha256) in the state, one whose file has changed
    is left out unless forced.
    """
    wire = maps.required(state["maps"])
    if "hashes" in state:
        same = state["hashes"].filter(files.same_file(F.col("expected"), F.col("sha256"), bool(options.get("force"))))
        wire = wire.join(same.select("doc_id"), "doc_id", "left_semi")
    table = store.Table(wire.sparkSession, options["path"], ("doc_id",))
    table.replace(wire)
    return state | {"maps": table.read()}


STEPS: dict[str, Callable[[State, dict], State]] = {"read": read_step, "detect": detect_step, "duplicate": duplicate_step, "mask": mask_step, "embed": embed_step}


def run(docs: DataFrame, steps: list[dict]) -> State:
    """steps: [{"op": name, "options": {...}}, ...]; an unknown name is an error before anything runs."""
    if wrong := [s.get("op") for s in steps if s.get("op") not in STEPS]:
        raise ValueError(f"unknown steps {wrong}; known: {', '.join(STEPS)}")
    state: State = {"docs": docs}
    for step in steps:
        state = STEPS[step["op"]](state, step.get("options") or {})
    return state

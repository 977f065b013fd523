"""Tables that are replaced key by key: sessions, pages of results, and the ledger of a corpus run.

A table is a folder of parts that are only ever added.  A write puts its rows and the keys that it replaces aside, then
creates the next manifest, which names all parts in order; creating a file that must not exist yet is the commit.  What a
writer leaves behind that fails before is named by no manifest and so never read.  Of each key the rows of the last part
that replaces it count - none, where that part has none.  Two writers that meet both get in, the second after the first.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts beyond which a write puts the table together first.
PARTS = 64


class Table:
    """A replaceable table at a path of any file system that Spark reads; keys are columns that are never null."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _files(self):
        context = self.spark.sparkContext
        jvm = context._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return jvm, at.getFileSystem(context._jsc.hadoopConfiguration()), at

    def _manifests(self) -> list[int]:
        """Numbers of the manifests, the last first, readable or not."""
        _, fs, at = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((int(n[:-5]) for n in names if re.fullmatch(r"[0-9]+\.json", n)), reverse=True)

    def parts(self, version: int | None = None) -> list[str]:
        """The parts of the last manifest that was written whole, up to a version."""
        jvm, fs, at = self._files()
        for n in self._manifests():
            if version is not None and n > version:
                continue
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(at, f"{n}.json"))
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return json.loads(text)["parts"]
            except (ValueError, KeyError):
                continue  # its writer was lost while writing it
        return []

    def _commit(self, change) -> int:
        """Makes change(parts) the parts; tries again after another writer's commit."""
        jvm, fs, at = self._files()
        while True:
            parts, number = change(self.parts()), max(self._manifests(), default=0) + 1
            try:
                out = fs.create(jvm.org.apache.hadoop.fs.Path(at, f"{number}.json"), False)
            except Exception as e:  # noqa: BLE001 - the JVM's exception has no Python class
                if number in self._manifests():
                    continue
                raise OSError(f"manifest {number} of {self.path} could not be created") from e
            out.write(bytearray(json.dumps({"parts": parts}).encode()))
            out.close()
            return number

    def _written(self, rows: DataFrame, scope: DataFrame | None) -> str:
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/rows/part={part}")
        # Without a scope the keys are those of the rows as they were written: rows are made once.
        own = self.spark.read.parquet(f"{self.path}/rows/part={part}") if scope is None else scope
        own.select(*self.keys).distinct().write.parquet(f"{self.path}/scope/part={part}")
        return part

    def replace(self, rows: DataFrame, scope: DataFrame | None = None) -> int:
        """rows instead of all rows of the keys in scope - of the rows' own keys, if none is given; the new version's number.

        Rows whose key isn't in scope are not written.  Only the given rows are written, however large the table is.
        """
        if scope is not None:
            rows = rows.join(scope.select(*self.keys).distinct(), self.keys, "left_semi").select(*rows.columns)
        if len(self.parts()) >= PARTS:
            self.compact()
        part = self._written(rows, scope)
        return self._commit(lambda parts: [*parts, part])

    def _all(self, kind: str, parts: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{kind}").option("mergeSchema", "true").parquet(*[f"{self.path}/{kind}/part={p}" for p in parts])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version, or as it is; None before the first write."""
        parts = self.parts(version)
        if not parts:
            return None
        rows = self._all("rows", parts)
        if len(parts) == 1:
            return rows.drop("part")
        turn = F.array_position(F.array(*map(F.lit, parts)), F.col("part"))
        latest = self._all("scope", parts).groupBy(*self.keys).agg(F.max(turn).alias("turn"))
        return rows.withColumn("turn", turn).join(latest, [*self.keys, "turn"], "left_semi").drop("part", "turn")

    def compact(self) -> int | None:
        """The same table in one part; parts that others add meanwhile stay behind it."""
        before = self.parts()
        if len(before) < 2:
            return None
        part = self._written(self.read(), None)
        return self._commit(lambda parts: [part, *[p for p in parts if p not in before]])


RESULTS = ("read_result", "detect_result", "duplicate_result", "ocr_result")


def session_rows(rows: DataFrame) -> DataFrame:
    """(path, content_hash, readable, read_result, detect_result, duplicate_result, ocr_result) of rows with a payload, the session's JSON text.

    Results are VARIANT values.  A payload that names none of the four is the old shape, a single result: it counts as read,
    and as detected if it lists detections.  One that isn't a JSON object gives no results and isn't readable.
    """
    parsed = rows.withColumn("v", F.try_parse_json("payload"))
    parsed = parsed.withColumn("readable", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    v = F.when(F.col("readable"), F.col("v"))
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    new = F.lit(False)
    for name in RESULTS:
        new = new | part(name).isNotNull()
    detections = F.coalesce(F.size(F.try_variant_get(v, "$.detect", "array<variant>")), F.lit(0)) > 0
    old = {"read_result": v, "detect_result": F.when(detections, v)}
    known = lambda name: F.when(new & ~F.is_variant_null(part(name)), part(name))
    results = [F.coalesce(known(name), F.when(~new, old[name])).alias(name) if name in old else known(name).alias(name) for name in RESULTS]
    digest = F.coalesce(F.col("content_hash"), F.try_variant_get(v, "$.content_hash", "string")) if "content_hash" in rows.columns else F.try_variant_get(v, "$.content_hash", "string")
    return parsed.select("path", digest.alias("content_hash"), "readable", *results)


def payload() -> Column:
    """The session's JSON text of a saved row (path, content_hash and the four results); results that are missing are null."""
    listed = [F.concat(F.lit(f'"{name}": '), F.coalesce(F.to_json(name), F.lit("null"))) for name in RESULTS]
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    head = [F.concat(F.lit('"pdf_path": '), quoted(F.coalesce("path", F.lit("")))), F.concat(F.lit('"content_hash": '), quoted(F.coalesce("content_hash", F.lit(""))))]
    return F.concat(F.lit("{"), F.array_join(F.array(*head, *listed), ", "), F.lit("}"))


def restored(files: DataFrame, sidecars: DataFrame | None, embedded: DataFrame | None, accept_changed: bool = True) -> DataFrame:
    """(path, source, changed, read_result, detect_result, duplicate_result, ocr_result) of every file (path, content_hash).

    A readable sidecar goes before an embedded session.  changed tells that the sidecar was saved for other contents; with
    accept_changed off such a file restores nothing.  An embedded session is taken as it is.
    """
    out = files.select("path", F.col("content_hash").alias("now"))
    taken = []
    for name, rows in (("sidecar", sidecars), ("embedded", embedded)):
        if rows is not None:
            own = F.struct("content_hash", *RESULTS)
            out = out.join(rows.filter("readable").select("path", own.alias(name)), "path", "left")
            taken.append(name)
    if not taken:
        return out.select("path", F.lit(None).cast("string").alias("source"), F.lit(False).alias("changed"), *[F.lit(None).cast("variant").alias(r) for r in RESULTS])
    source = F.coalesce(*[F.when(F.col(n).isNotNull(), n) for n in taken])
    changed = F.coalesce((source == "sidecar") & (F.col("sidecar.content_hash") != "") & (F.col("sidecar.content_hash") != F.col("now")), F.lit(False)) if "sidecar" in taken else F.lit(False)
    out = out.withColumn("source", source).withColumn("changed", changed)
    used = F.lit(True) if accept_changed else ~F.col("changed")
    best = lambda r: F.when(used, F.when(source == taken[0], F.col(f"{taken[0]}.{r}")).otherwise(F.col(f"{taken[-1]}.{r}")))
    return out.select("path", "source", "changed", *[best(r).alias(r) for r in RESULTS])


def result_of(value: Column, schema: str, path: Column | None = None) -> Column:
    """A VARIANT result in the shape of schema, as belonging to the file at path where one is given."""
    typed = F.from_json(F.to_json(value), schema)
    return typed if path is None else F.when(typed.isNotNull(), typed.withField("metadata.pdf.path", path))

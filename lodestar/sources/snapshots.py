"""Immutable generations of tables and the journal that says which is current.

A generation is a folder that is written once. Publishing writes the folder, validates it, and then adds an entry to the
journal, which names the generation it follows. The last entry of the unbroken chain is the current generation; readers
resolve it once and then see one generation whatever happens. HEAD.json only says where in the journal to begin, so a
publisher may stop anywhere: before its entry nothing has changed, and after it the generation is published.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Read = Callable[[str], DataFrame]
Table = Callable[[Read], DataFrame]


def state_of(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the files below ``path``: it differs if the table there has been rewritten."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    seen = []
    while found.hasNext():
        status = found.next()
        seen.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return json.dumps(sorted(seen))


def digest(rows: DataFrame) -> list[Column]:
    """How many rows there are and the sum of their hashes, which no order or partitioning of them changes."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(hashed), F.lit(0)).cast("string").alias("digest")]


class Store:
    """Generations below ``root``, through Hadoop's file system API, so any store that Spark writes to will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def head(self) -> dict | None:
        """The current entry: generation, base, epoch and the tables' schemas; None before the first publication.

        Entries follow the one that HEAD.json names, if it can be read, else the journal's first. An entry that was never
        finished, that a later publisher has voided or that follows another generation than the current one counts for nothing.
        """
        now = self._entry(f"{self.root}/HEAD.json")
        for epoch in sorted(e for e in self._epochs() if e > (now or {}).get("epoch", 0)):
            entry = None if self._exists(self._journal(epoch) + ".void") else self._entry(self._journal(epoch))
            if entry and entry["base"] == (now or {}).get("generation"):
                now = entry
        return now

    def publish(self, tables: dict[str, DataFrame | Table], generation: str, expected: str | None, facts: Callable[[Read], dict] | None = None, digests: tuple[str, ...] = ()) -> dict:
        """Writes all tables of a generation, checks them, and makes it follow ``expected``.

        A table given as a function is made after those before it are written, from what it reads of them by name. So
        are ``facts``, which are kept in the entry. Two publishers of one base cannot both be followed: the entry of an epoch is created exclusively, and an
        unfinished one is voided before the next is tried. The tables named in ``digests`` get a digest in the entry, which
        ``checked`` holds them against; it is taken from the rows as they are written.
        """
        folder = f"{self.root}/generations/{generation}"
        schemas: dict[str, StructType] = {}
        seen: dict[str, Observation] = {}
        read = lambda name: self.read(generation, name, schemas[name])
        for name, given in tables.items():
            table = given(read) if callable(given) else given
            if name in digests:
                seen[name] = Observation(f"digest-{uuid.uuid4().hex}")
                table = table.observe(seen[name], *digest(table))
            writer = table.write.mode("errorifexists")
            (writer.partitionBy("bucket") if "bucket" in table.columns else writer).parquet(f"{folder}/{name}")
            schemas[name] = table.schema
        for name, schema in schemas.items():
            if {"doc_id", "version_id"} <= set(schema.names) and name == "projection" and not self.read(generation, name, schema).groupBy("doc_id").count().where("count > 1").isEmpty():
                raise ValueError("a document is published twice")
        now = self.head()
        if (now or {}).get("generation") != expected:
            raise RuntimeError("the base generation is no longer current")
        epoch = (now or {}).get("epoch", 0) + 1
        while self._exists(self._journal(epoch)):
            voided, rival = self._exists(self._journal(epoch) + ".void"), self._entry(self._journal(epoch))
            if rival and rival["base"] == expected and not voided:
                raise RuntimeError("the base generation is no longer current")
            if rival is None and not voided:
                self._create(self._journal(epoch) + ".void", {}, True)
            epoch += 1
        entry = {"generation": generation, "base": expected, "epoch": epoch, "tables": sorted(tables), "schemas": {n: s.jsonValue() for n, s in schemas.items()}, "facts": facts(read) if facts else {}, "digests": {n: dict(o.get) for n, o in seen.items()}}
        self._create(self._journal(epoch), entry, False)
        if (self.head() or {}).get("generation") != generation:
            raise RuntimeError("the base generation is no longer current")
        self._create(f"{self.root}/HEAD.json", entry, True)
        return entry

    def _journal(self, epoch: int) -> str:
        return f"{self.root}/journal/{epoch:012d}.json"

    def _epochs(self) -> list[int]:
        journal = self._path(f"{self.root}/journal")
        names = [s.getPath().getName() for s in self._fs.listStatus(journal)] if self._fs.exists(journal) else []
        return [int(n[:-5]) for n in names if n.endswith(".json")]

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def _entry(self, name: str) -> dict | None:
        """An entry, or None if there is none or its writer stopped in between."""
        if not self._exists(name):
            return None
        try:
            return json.loads(self._text(name))
        except ValueError:
            return None

    @contextlib.contextmanager
    def staged(self, tables: dict[str, DataFrame], name: str) -> Iterator[dict[str, DataFrame]]:
        """The tables written once and reread, so that what derives from them does not compute them again."""
        folder = f"{self.root}/staging/{name}"
        for table, rows in tables.items():
            rows.write.mode("errorifexists").parquet(f"{folder}/{table}")
        try:
            yield {table: self.spark.read.schema(rows.schema).parquet(f"{folder}/{table}") for table, rows in tables.items()}
        finally:
            self._fs.delete(self._path(folder), True)

    def _create(self, name: str, value: dict, overwrite: bool) -> None:
        stream = self._fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()

    def read(self, generation: str, name: str, schema: StructType | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.root}/generations/{generation}/{name}")

    def current(self, name: str, head: dict | None = None) -> DataFrame:
        """A table of the current generation, or of that of an entry already read; its schema is not inferred again."""
        head = head or self.head()
        if head is None:
            raise LookupError("nothing is published")
        schema = head.get("schemas", {}).get(name)
        return self.read(head["generation"], name, StructType.fromJson(schema) if schema else None)

    def checked(self, name: str, head: dict | None = None) -> DataFrame:
        """A table of the current generation whose rows are still those that were published; ValueError if they are not.

        Reads the whole table once. A table without a digest is refused too.
        """
        head = head or self.head()
        if head is None:
            raise LookupError("nothing is published")
        rows, told = self.current(name, head), head.get("digests", {}).get(name)
        # Columns in the order in which they were hashed.
        hashed = rows.select(*[f"`{c}`" for c in StructType.fromJson(head["schemas"][name]).names])
        if told is None or hashed.agg(*digest(hashed)).first().asDict() != told:
            raise ValueError(f"{name} is not what was published")
        return rows

    def collect_garbage(self, keep: int, leased: frozenset[str] = frozenset()) -> list[str]:
        """Deletes generations that are neither among the last ``keep`` of the journal nor leased; orphans go too.

        What an entry that is kept says its tables still use (``facts.uses``) stays as well.
        """
        chain, uses = {}, {}
        for epoch in sorted(self._epochs()):
            entry = None if self._exists(self._journal(epoch) + ".void") else self._entry(self._journal(epoch))
            if entry and entry["base"] == next(reversed(chain), None):
                chain[entry["generation"]] = epoch
                uses[entry["generation"]] = entry.get("facts", {}).get("uses", [])
        kept = set(list(chain)[-keep:]) | leased if keep else set(leased)
        kept |= {used for name in kept for used in uses.get(name, [])}
        gone = []
        for status in self._fs.listStatus(self._path(f"{self.root}/generations")):
            name = status.getPath().getName()
            if name not in kept:
                self._fs.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def incremental(base: DataFrame, removed: DataFrame, replacements: DataFrame, key: str = "doc_id") -> DataFrame:
    """The next generation of a table: the base without removed and replaced keys, and the replacements."""
    gone = removed.select(key).unionByName(replacements.select(key)).distinct()
    return base.join(gone, key, "left_anti").unionByName(replacements)


def incremental_vectors(base: DataFrame, projection: DataFrame, removed: DataFrame, replacements: DataFrame) -> DataFrame:
    """Base vectors that the projection still has, without removed and replaced ones, and the replacements."""
    still = base.join(projection.select("doc_id", "version_id"), ["doc_id", "version_id"], "left_semi")
    return incremental(still, removed, replacements, "vector_id")


def vector_violations(vectors: DataFrame, projection: DataFrame, model_id: str, dimension: int) -> DataFrame:
    """One row: vectors outside the projection, of another model, or of another length."""
    there = projection.select("doc_id", "version_id").withColumn("_there", F.lit(1))
    joined = vectors.join(there, ["doc_id", "version_id"], "left")
    return joined.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(F.col("_there").isNull()).alias("outside"),
        F.count_if(F.col("model_id") != model_id).alias("other_model"),
        F.count_if(F.size("values") != dimension).alias("other_dimension"),
    )


def retention(journal: DataFrame, keep: int, leased: DataFrame) -> DataFrame:
    """Generations of the journal that may be deleted."""
    newest = journal.orderBy(F.desc("epoch")).limit(keep).select("generation")
    return journal.select("generation").distinct().join(newest, "generation", "left_anti").join(leased.select("generation"), "generation", "left_anti")

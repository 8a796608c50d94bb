"""Command line: ``python -m lodestar import FOLDER STORE``, ``search STORE QUERY``, ``status STORE``, ``detail STORE DOC``,
``delete STORE DOC``, ``purge STORE DOC``, ``doctor STORE``, ``export STORE FOLDER``, ``gc STORE``.

An import adds to what is published; files that are imported again replace their documents. ``delete`` makes a document
invisible; ``purge`` also deletes the generations that still hold it.
"""

from __future__ import annotations

import argparse
import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.plans import engine
from lodestar.sources.snapshots import Store


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("lodestar")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in (("import", ["folder", "store"]), ("search", ["store", "query"]), ("status", ["store"]), ("detail", ["store", "doc"]), ("delete", ["store", "doc"]), ("purge", ["store", "doc"]), ("doctor", ["store"]), ("export", ["store", "folder"]), ("gc", ["store"])):
        one = commands.add_parser(name)
        for m in more:
            one.add_argument(m)
        if name == "search":
            one.add_argument("--top", type=int, default=10)
            one.add_argument("--filters", default="{}")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    store = Store(spark, a.store)
    head = store.head()
    base = head["generation"] if head else None
    if a.command == "import":
        name = uuid.uuid4().hex
        with store.staged(engine.import_folder(spark, a.folder), name) as tables:
            made, facts = engine.next_generation(store, tables, tables["documents"].select("doc_id"), name)
            print(json.dumps(store.publish(made, name, base, facts, engine.DIGESTS)))
    elif a.command == "search":
        corpus = engine.corpus_of(store.current("projection"), store.current("mentions"), engine.read_index(store))
        for hit in engine.search(spark, corpus, a.query, "fulltext", a.top, json.loads(a.filters)).hits.orderBy("rank").toLocalIterator():
            print(json.dumps(hit.asDict(), ensure_ascii=False))
    elif a.command == "status":
        for row in store.current("versions").groupBy("status").count().orderBy("status").toLocalIterator():
            print(json.dumps(row.asDict()))
    elif a.command == "detail":
        value, confidence = text.detail_value(F.col("raw_value"), F.col("normalized_value"), F.col("confidence"))
        owned = store.current("mentions").join(store.current("projection").where(F.col("doc_id") == a.doc).select("version_id"), "version_id", "left_semi")
        for row in owned.select("entity_type", value.alias("value"), confidence.alias("confidence")).toLocalIterator():
            print(json.dumps(row.asDict(), ensure_ascii=False))
    elif a.command in ("delete", "purge"):
        gone = spark.createDataFrame([(a.doc,)], "doc_id string")
        none = {name: store.current(name).limit(0) for name in ("documents", "versions", "mentions", "projection")}
        name = uuid.uuid4().hex
        made, facts = engine.next_generation(store, none, gone, name, a.command == "purge")
        print(json.dumps(store.publish(made, name, base, facts, engine.DIGESTS)))
        if a.command == "purge":
            print(json.dumps(store.collect_garbage(1)))
    elif a.command == "doctor":
        found = engine.problems(store) + engine.changed_tables(store)
        print(json.dumps({"problems": found}))
        return int(bool(found))
    elif a.command == "export":
        store.current("projection").drop("bucket").write.json(a.folder)
    else:
        print(json.dumps(store.collect_garbage(2)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Operators over the metadata tables: hydration, identities, occurrences, jobs, projections and audits.

A change of a table is a new table: these return what it shall hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vectorised import small_batches

MOST_HYDRATED = 256
SOFT_DUPLICATE = 0.70
#: Likeness of two profiles of one name, by 8 for a common school, 4 for a common company and 1 for each of up to three common skills.
SOFT_SCORES = np.array([round(min(0.95, 0.45 + 0.25 * (i >= 8) + 0.20 * (i % 8 >= 4) + 0.10 * (i % 4) / 3), 6) for i in range(16)])
#: Profiles of one fact in a block, comparisons at a time, cells for a thread in which blocks meet, and blocks of a stripe.
LONG, PAIRS, CELLS, STRIPE = 2000, 1 << 18, 8, 256
#: Founded contacts of a kind that are broadcast; a shuffle join beyond.
FEW_CONTACTS = 100_000


def hydrate(hits: DataFrame, active: DataFrame) -> DataFrame:
    """hits with the columns of their exact (doc_id, version_id), in order; no other version stands in.

    A hit without its row, or more hits than MOST_HYDRATED, is an error at run time.
    """
    found = F.broadcast(hits.limit(MOST_HYDRATED + 1)).join(active.withColumn("_there", F.lit(True)), ["doc_id", "version_id"], "left")
    number = F.count(F.lit(1)).over(Window.partitionBy())
    problem = F.when(number > MOST_HYDRATED, "too many hits").when(F.col("_there").isNull(), "a hit is stale or unknown")
    checked = found.withColumn("_problem", problem).withColumn("rank", F.when(F.col("_problem").isNotNull(), F.raise_error(F.col("_problem")).cast("int")).otherwise(F.col("rank")))
    return checked.drop("_there", "_problem").orderBy("rank")


def resolve_selection(asked: DataFrame, sealed: DataFrame, active: DataFrame) -> DataFrame:
    """state of each asked (doc_id, version_id): current, stale (once sealed, now another version) or not_found."""
    known = sealed.select("doc_id", "version_id").distinct().withColumn("_sealed", F.lit(True))
    head = active.select("doc_id", F.col("version_id").alias("_active"))
    joined = asked.join(known, ["doc_id", "version_id"], "left").join(head, "doc_id", "left")
    state = F.when(F.col("_sealed").isNull(), "not_found").when(F.col("_active") == F.col("version_id"), "current").otherwise("stale")
    return joined.select(*asked.columns, state.alias("state"))


def reviewed(assignments: DataFrame, decisions: DataFrame) -> DataFrame:
    """version_id, candidate_id, manual: assignments after a ledger of manual decisions, replayed in order.

    assignments: version_id, candidate_id. decisions: decision_id (order), kind, versions, candidate_id, confidence. A
    ``merge`` assigns its versions to a manual candidate; a ``split`` clears those that are with it at that point, and
    leaves them without a candidate until they are merged again. Merges of fewer than two versions or without a confidence
    from 0 to 1 count for nothing, nor do splits of candidates that no merge has made. A repeated entry counts once.

    Only the last merge of a version says where it is, and only the last split of that candidate can clear it, so the replay
    is two aggregations, whatever the length of the ledger.
    """
    sound = (F.col("kind") == "merge") & (F.size(F.array_distinct("versions")) > 1) & F.col("confidence").between(0, 1)
    merged = decisions.where(sound & F.col("candidate_id").isNotNull()).select("decision_id", "candidate_id", F.explode("versions").alias("version_id"))
    last = merged.groupBy("version_id").agg(F.max(F.struct("decision_id", "candidate_id")).alias("_last")).select("version_id", "_last.*")
    splits = decisions.where("kind = 'split'").groupBy("candidate_id").agg(F.max("decision_id").alias("_split"))
    placed = last.withColumnRenamed("candidate_id", "_manual").join(splits.withColumnRenamed("candidate_id", "_manual"), "_manual", "left")
    now = placed.select("version_id", F.when(F.coalesce(F.col("_split") <= F.col("decision_id"), F.lit(True)), F.col("_manual")).alias("_manual"), F.lit(True).alias("_reviewed"))
    joined = assignments.select("version_id", "candidate_id").join(now, "version_id", "left")
    return joined.select("version_id", F.when(F.col("_reviewed"), F.col("_manual")).otherwise(F.col("candidate_id")).alias("candidate_id"), F.col("_manual").isNotNull().alias("manual"))


def assign_candidates(contacts: DataFrame) -> DataFrame:
    """version_id, candidate_id, email_candidate, phone_candidate (both set and different: a conflict, no assignment).

    contacts: version_id, committed (order), email_hash, phone_hash. The rule is sequential: a version joins the
    candidate of its e-mail or phone, founds one if neither is known, and never adds a contact to a candidate it joins.

    It is computed in rounds over all versions at once. The first undecided version of all its contacts founds; whoever
    shares a contact with a founder is decided by that. Each round is a table of its own, so no group of versions, however
    large, meets in one task. Contacts cross as 128 bits of their hash, as many as a candidate's name has; founders are found
    among the first version of each contact, and where few contacts are founded they are broadcast.
    """
    kinds = ("email", "phone")
    bits = lambda kind: F.unhex(F.substring(F.sha2(f"{kind}_hash", 256), 1, 32)).alias(kind)
    named = contacts.select("version_id", "committed", *map(bits, kinds))
    undecided, owners, founded = named.where("email IS NOT NULL OR phone IS NOT NULL"), None, dict.fromkeys(kinds, 0)
    side = lambda of, kind, n: F.broadcast(of.where(F.col("kind") == kind)) if n <= FEW_CONTACTS else of.where(F.col("kind") == kind)
    while True:
        ends = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("contact")) for k in kinds]), lambda e: e["contact"].isNotNull())
        held = undecided.select(F.struct("committed", "version_id", F.size(ends).alias("n")).alias("by"), F.explode(ends).alias("end"))
        first = held.groupBy("end").agg(F.min("by").alias("by"))
        founders = first.groupBy("by").agg(F.collect_list("end").alias("held")).where(F.size("held") == F.col("by.n"))
        new = founders.select("by.committed", "by.version_id", F.explode("held").alias("end")).select("end.*", F.struct("committed", "version_id").alias("by")).checkpoint()
        number = {r["kind"]: r["count"] for r in new.groupBy("kind").count().collect()}
        if not number:
            break
        owners = new if owners is None else owners.unionByName(new)
        for kind in sorted(number, key=number.get):
            founded[kind] += number[kind]
            undecided = undecided.join(side(new, kind, number[kind]).select(F.col("contact").alias(kind)), kind, "left_anti")
        undecided = undecided.checkpoint()
    if owners is None:
        return contacts.select("version_id", *[F.lit(None).cast("string").alias(c) for c in ("candidate_id", "email_candidate", "phone_candidate")])
    out = named
    for kind in sorted(kinds, key=founded.get):
        out = out.join(side(owners, kind, founded[kind]).select(F.col("contact").alias(kind), F.col("by").alias(f"{kind}_by")), kind, "left")
    order = F.struct("committed", "version_id")
    candidate = lambda kind: F.concat(F.lit("cand_"), F.substring(F.sha2(F.col(f"{kind}_by.version_id").cast("string"), 256), 1, 32))
    # A contact is known to a version only if its founder came before.
    email, phone = (F.when(F.col(f"{k}_by") < order, candidate(k)) for k in kinds)
    own = F.coalesce(*[F.when(F.col(f"{k}_by") == order, candidate(k)) for k in kinds])
    chosen = F.when(email.isNotNull() & phone.isNotNull() & (email != phone), None).otherwise(F.coalesce(email, phone, own))
    return out.select("version_id", chosen.alias("candidate_id"), email.alias("email_candidate"), phone.alias("phone_candidate"))


def version_counts(candidates: DataFrame, assignments: DataFrame, active: DataFrame) -> DataFrame:
    """candidates with version_count: versions of theirs in the active projection."""
    counts = assignments.join(active.select("version_id"), "version_id", "left_semi").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"))
    return candidates.drop("version_count").join(counts, "candidate_id", "left").withColumn("version_count", F.coalesce("n", F.lit(0))).drop("n")


def soft_duplicates(profiles: DataFrame) -> DataFrame:
    """doc_left, doc_right, score of profiles (doc_id, name, schools, companies, skills) of one name over SOFT_DUPLICATE.

    A score over the threshold needs a common school or company, so profiles meet by name and one such fact, a pair at the
    first fact that it has. The profiles of a fact are dealt over blocks of some LONG, a row each, and the blocks over
    stripes, any two of which meet in a cell. There are CELLS cells for a thread, shared among the facts by their pairs, so a
    block crosses as often as the threads ask for, however many profiles there are, or once for STRIPE blocks where that is
    more, since a merge join holds the blocks of a cell. They go to Python two at a time; there they are compared as sets of
    bits, and pairs leave by pieces of PAIRS.
    """
    small_batches(profiles.sparkSession)
    facts = lambda kind, values: F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    whole = profiles.where(" AND ".join(f"{c} IS NOT NULL" for c in ("doc_id", "name", "schools", "companies", "skills")))
    on = F.explode(F.array_distinct(F.concat(facts(0, F.col("schools")), facts(1, F.col("companies"))))).alias("_on")
    keyed = whole.select("doc_id", "name", "schools", "companies", "skills", on).select("*", "_on.kind", "_on.value").drop("_on").where("kind IS NOT NULL AND value IS NOT NULL")
    fact, tasks = ["name", "kind", "value"], CELLS * profiles.sparkSession.sparkContext.defaultParallelism
    held = keyed.groupBy(*fact).agg(F.count(F.lit(1)).cast("double").alias("_n")).where("_n > 1")
    share = F.col("_n") * F.col("_n") / F.col("_all")
    blocks = F.ceil(F.col("_n") / LONG).cast("int")
    parts = held.crossJoin(F.broadcast(held.agg(F.sum(F.col("_n") * F.col("_n")).alias("_all")))).select(*fact, blocks.alias("_blocks"), F.least(blocks, F.greatest(F.ceil(F.sqrt(2 * tasks * share)), F.ceil(blocks / STRIPE)).cast("int")).alias("_stripes"))
    dealt = keyed.join(parts, fact).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int"))
    rows = dealt.groupBy(*fact, "block", "_stripes").agg(F.collect_list(F.struct("doc_id", "schools", "companies", "skills")).alias("rows"))
    own = rows.withColumn("stripe", F.pmod("block", "_stripes")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_stripes") - 1)))
    cells = own.select(*fact, F.least("stripe", "_other").alias("at"), F.greatest("stripe", "_other").alias("to"), F.struct("block", "stripe", "rows").alias("low"))
    # The work is in the pairs, not in the bytes, so a task's share is not left to the size of its input.
    keys = [*fact, "at", "to"]
    cells = cells.repartition(tasks, *keys)
    met = cells.hint("merge").join(cells.withColumnRenamed("low", "high"), keys).where("low.stripe < high.stripe OR low.stripe = high.stripe AND low.block <= high.block AND at = to")
    doc = profiles.schema["doc_id"].dataType.simpleString()
    return met.select(*fact, "low", "high").mapInArrow(_met, f"doc_left {doc}, doc_right {doc}, score double")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of the two blocks in each row."""
    for batch in batches:
        for i in range(len(batch)):
            low, high = ({f.name: c for f, c in zip(s.type, s.flatten(), strict=True)} for s in (batch[c].slice(i, 1) for c in ("low", "high")))
            apart = low["block"][0] != high["block"][0]
            sides = [s["rows"].flatten() for s in ((low, high) if apart else (low,))]
            names = [f.name for f in sides[0].type]
            columns = [pa.concat_arrays(c) for c in zip(*(s.flatten() for s in sides), strict=True)]
            part = pa.array(np.repeat([0, 1][: len(sides)], [len(s) for s in sides]))
            key = (*(batch[c][i] for c in ("name", "kind", "value")), pa.scalar(0), pa.scalar(int(apart)))
            yield from _compared(key, iter([pa.RecordBatch.from_arrays([*columns, part], [*names, "part"])]))


def _bits(lists: pa.ListArray, nulls: bool) -> tuple[np.ndarray, list]:
    """Sets as bits, a row of 64-bit words for each list, and what the bits stand for; values of one list only are left out."""
    rows, coded = lists.value_parent_indices().to_numpy(), lists.flatten().dictionary_encode("encode" if nulls else "mask")
    there = coded.is_valid().to_numpy(zero_copy_only=False)
    held = np.unique(coded.indices.fill_null(0).to_numpy().astype(np.int64)[there] * len(lists) + rows[there])
    code, row = np.divmod(held, len(lists))
    shared = np.flatnonzero(np.bincount(code, minlength=len(coded.dictionary)) > 1)
    place = np.full(len(coded.dictionary), -1)
    place[shared] = np.arange(len(shared))
    code = place[code]
    code, row = code[code >= 0], row[code >= 0]
    words = np.zeros((len(lists), -(-len(shared) // 64)), np.uint64)
    np.bitwise_or.at(words, (row, code // 64), np.uint64(1) << (code % 64).astype(np.uint64))
    return words, coded.dictionary.take(pa.array(shared)).to_pylist()


def _compared(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of two parts of a fact's profiles, or of one part; pairs that have an earlier fact in common are found there."""
    _, kind, value, low, high = [k.as_py() for k in key]
    rows = pa.Table.from_batches(list(batches)).combine_chunks()
    rows = rows.take(pc.sort_indices(rows["part"]))
    column = lambda name: pa.concat_arrays(rows[name].chunks)
    ids, n = column("doc_id"), len(rows)
    cut = int(np.searchsorted(rows["part"].to_numpy(), low, "right")) if low < high else n
    rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
    first, second = slice(0, cut), slice(cut, n) if low < high else slice(0, n)
    sides = []
    for order, name in enumerate(("schools", "companies", "skills")):
        words, values = _bits(column(name), name == "skills")
        earlier = np.array([order < kind or order == kind and v < value for v in values] + [False] * (-len(values) % 64), bool).reshape(-1, 64)
        masks = (earlier.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)
        sides.append((words, masks))
    held = second.stop - second.start
    for at in range(0, cut if held else 0, step := max(1, PAIRS // max(1, held))):
        to = min(cut, at + step)
        found = np.zeros((to - at, held), np.uint8)
        seen = np.zeros((to - at, held), bool)
        for weight, (words, masks) in zip((8, 4, 1), sides, strict=True):
            common = np.zeros((to - at, held), np.uint8)
            for w in range(words.shape[1]):
                both = words[at:to, w, None] & words[None, second, w]
                if weight == 1:
                    common = np.minimum(common + np.bitwise_count(both), 3)
                else:
                    common |= (both != 0).view(np.uint8)
                    if masks[w]:
                        seen |= (both & masks[w]) != 0
            found += common * np.uint8(weight)
        hits = (SOFT_SCORES > SOFT_DUPLICATE)[found] & ~seen
        if low == high:
            hits &= rank[at:to, None] < rank[None, second]
        a, b = np.nonzero(hits)
        score = SOFT_SCORES[found[a, b]]
        a, b = a + at, b + second.start
        ordered = rank[a] < rank[b]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.where(ordered, a, b))), ids.take(pa.array(np.where(ordered, b, a))), pa.array(score)], ["doc_left", "doc_right", "score"])


def removed_occurrences(present: DataFrame, seen: DataFrame, errors: int) -> DataFrame:
    """Occurrences (root_id, relative_path, doc_id) that a scan did not see; none if the scan had errors."""
    return present.join(seen.select("root_id", "relative_path"), ["root_id", "relative_path"], "left_anti") if errors == 0 else present.limit(0)


def unreferenced(removed: DataFrame, present: DataFrame) -> DataFrame:
    """Documents of removed occurrences that no other present occurrence has."""
    left = present.join(removed.select("root_id", "relative_path"), ["root_id", "relative_path"], "left_anti")
    return removed.select("doc_id").distinct().join(left.select("doc_id"), "doc_id", "left_anti")


def merge_occurrences(current: DataFrame, scanned: DataFrame) -> DataFrame:
    """root_id, relative_path, doc_id, revision_id, action of every scanned occurrence: inserted, unchanged or replaced."""
    old = current.select("root_id", "relative_path", F.col("doc_id").alias("_doc"), F.col("revision_id").alias("_revision"), F.col("state").alias("_state"))
    joined = scanned.join(old, ["root_id", "relative_path"], "left")
    same = (F.col("_state") == "present") & (F.col("_doc") == F.col("doc_id")) & (F.col("_revision") == F.col("revision_id"))
    action = F.when(F.col("_state").isNull(), "inserted").when(same, "unchanged").otherwise("replaced")
    return joined.select("root_id", "relative_path", "doc_id", "revision_id", action.alias("action"), F.when(action == "replaced", F.col("_doc")).alias("displaced_doc_id"))


def active_per_root(occurrences: DataFrame, active: DataFrame) -> DataFrame:
    """root_id, n: present occurrences whose document has an active version of the same revision."""
    present = occurrences.where("state = 'present'")
    there = present.join(active.select("doc_id", "revision_id"), ["doc_id", "revision_id"], "left_semi").groupBy("root_id").agg(F.count(F.lit(1)).alias("n"))
    return occurrences.select("root_id").distinct().join(there, "root_id", "left").select("root_id", F.coalesce("n", F.lit(0)).alias("n"))


def source_file(occurrences: DataFrame, roots: DataFrame, revisions: DataFrame, deleted: DataFrame) -> DataFrame:
    """One path for each document: its first present occurrence in an active root, of a revision, not being deleted."""
    joined = (
        occurrences.where("state = 'present'")
        .join(roots.where("active").select("root_id", "root_path"), "root_id")
        .join(revisions.select("revision_id", "content_hash"), "revision_id")
        .join(deleted.select("root_id"), "root_id", "left_anti")
    )
    first = Window.partitionBy("doc_id").orderBy("root_path", "relative_path")
    return joined.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def latest_completed(tasks: DataFrame, roots: DataFrame) -> DataFrame:
    """The last completed task of each active, unpaused root that has none pending."""
    order = Window.partitionBy("root_id").orderBy(F.desc("completed_at"), F.desc("task_id"))
    done = tasks.where("status = 'completed'").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    pending = tasks.where("status IN ('queued', 'running')").select("root_id")
    return done.join(roots.where("active AND NOT paused").select("root_id"), "root_id", "left_semi").join(pending, "root_id", "left_anti")


def due(rows: DataFrame, now: int, seconds: int, column: str = "completed_at") -> DataFrame:
    return rows.where(F.col(column) <= now - seconds)


def claimable(jobs: DataFrame, most: int = 1) -> DataFrame:
    """The oldest jobs that are queued, interrupted, or failed for now with attempts left."""
    ready = F.col("status").isin("queued", "interrupted") | ((F.col("status") == "failed_retryable") & (F.col("attempt_count") < F.col("max_attempts")))
    return jobs.where(ready).orderBy("queued_at", "job_id").limit(most)


def recover_stale(jobs: DataFrame, now: int, seconds: int = 900) -> DataFrame:
    """Jobs running for too long are interrupted, or failed if their attempts are used up."""
    stale = (F.col("status") == "running") & (F.col("started_at") <= now - seconds)
    new = F.when(stale & (F.col("attempt_count") >= F.col("max_attempts")), "failed").when(stale, "interrupted").otherwise(F.col("status"))
    return jobs.withColumn("status", new)


def requeue_for_model(jobs: DataFrame, specs: DataFrame, model_id: str, dimension: int) -> DataFrame:
    """Completed index jobs with a spec of this model and dimension are queued again, without attempts."""
    chosen = specs.where((F.col("model_id") == model_id) & (F.col("dimension") == dimension)).select("job_id").distinct().withColumn("_again", F.lit(True))
    again = F.col("_again") & (F.col("status") == "completed") & (F.col("kind") == "update_index")
    joined = jobs.join(chosen, "job_id", "left").withColumn("_again", F.coalesce(again, F.lit(False)))
    return joined.withColumn("attempt_count", F.when(F.col("_again"), 0).otherwise(F.col("attempt_count"))).withColumn("status", F.when(F.col("_again"), "queued").otherwise(F.col("status"))).drop("_again")


def rerun_decision(files: DataFrame, known: DataFrame, parse_version: str, epoch: str) -> DataFrame:
    """decision for each scanned file: unchanged, metadata_only (moved or renamed: the version is reused), reparse or new.

    A file is compared with what is known of its content at its own path, else at the first path. Known files are brought
    to a row per content and path and a row per content before they are joined, so equal contents, as of empty files,
    do not meet in pairs.
    """
    state = F.struct(F.col("normalized_path").alias("path"), F.col("parse_version").alias("parse"), F.col("classifier_epoch").alias("epoch"))
    here = known.groupBy("content_hash", "normalized_path").agg(F.min(state).alias("_here"))
    first = here.groupBy("content_hash").agg(F.min("_here").alias("_first"))
    joined = files.join(here, ["content_hash", "normalized_path"], "left").join(first, "content_hash", "left").withColumn("_known", F.coalesce("_here", "_first"))
    current = (F.col("_known.parse") == parse_version) & (F.col("_known.epoch") == epoch)
    decision = F.when(F.col("_known").isNull(), "new").when(~current, "reparse").when(F.col("_known.path") == F.col("normalized_path"), "unchanged").otherwise("metadata_only")
    return joined.select(*files.columns, decision.alias("decision"))


#: What has to run again when a part of the processing contract changes.
STRATEGIES = {"none": "reuse", "primary": "reparse", "ocr": "rerun_ocr", "derived": "rederive", "classifier": "reclassify", "multiple": "reparse", "unknown": "reparse"}


def contract_delta(old: dict[str, str] | None, new: dict[str, str]) -> tuple[str, str]:
    """(what changed, strategy) between two contracts with the keys primary, ocr, derived and classifier."""
    if old is None or set(old) != set(new):
        return "unknown", STRATEGIES["unknown"]
    parts = [k for k in ("primary", "ocr", "derived", "classifier") if old.get(k) != new.get(k)]
    what = "none" if not parts else parts[0] if len(parts) == 1 else "multiple"
    return what, STRATEGIES[what]


def project(base: DataFrame, removed: DataFrame, replacements: DataFrame) -> DataFrame:
    """base without removed and replaced documents, with the replacements; unique by document."""
    gone = removed.select("doc_id").unionByName(replacements.select("doc_id"))
    return base.join(gone, "doc_id", "left_anti").unionByName(replacements)


def repeated_documents(projection: DataFrame) -> DataFrame:
    return projection.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked(projection: DataFrame) -> DataFrame:
    """The projection; a document with two versions is an error."""
    if not repeated_documents(projection).isEmpty():
        raise ValueError("a document is projected twice")
    return projection


def audit_projection(projection: DataFrame, generation: str, seals: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """One row of violations: rows of another generation, without seal, not admitted, or unlike their document."""
    sealed = seals.select("version_id").distinct().withColumn("_seal", F.lit(1))
    admitted = classes.where("status = 'resume_candidate'").select("version_id").distinct().withColumn("_class", F.lit(1))
    source = documents.select("doc_id", F.col("content_hash").alias("_hash"), F.col("byte_size").alias("_size"))
    joined = projection.join(sealed, "version_id", "left").join(admitted, "version_id", "left").join(source, "doc_id", "left")
    unlike = ~(F.col("_hash").eqNullSafe(F.col("content_hash")) & F.col("_size").eqNullSafe(F.col("byte_size")))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return joined.agg(
        F.count(F.lit(1)).alias("members"),
        count(F.col("generation") != generation).alias("wrong_generation"),
        count(F.col("_seal").isNull()).alias("unsealed"),
        count(F.col("_class").isNull()).alias("not_admitted"),
        count(unlike).alias("unlike_document"),
    )


def check_manifest(manifest: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """One row: members, whether ordinals run from 0 without gap, and members whose key misses in a reference table.

    references: column of the manifest -> table with a column of the same name.
    """
    joined = manifest
    for name, table in references.items():
        joined = joined.join(table.select(name).distinct().withColumn(f"_{name}", F.lit(1)), name, "left")
    missing = sum((F.coalesce(F.sum(F.col(f"_{n}").isNull().cast("long")), F.lit(0)) for n in references), F.lit(0))
    gapless = (F.coalesce(F.min("ordinal"), F.lit(0)) == 0) & (F.coalesce(F.max("ordinal") + 1, F.lit(0)) == F.count(F.lit(1))) & (F.countDistinct("ordinal") == F.count(F.lit(1)))
    return joined.agg(F.count(F.lit(1)).alias("members"), gapless.alias("gapless"), missing.alias("violations"))


def purge_batch(documents: DataFrame, active: DataFrame, assignments: DataFrame, most: int) -> DataFrame:
    """candidate_id of all candidates that a purge of the next deleted documents affects. An active one is an error."""
    batch = documents.where("is_deleted").orderBy("doc_id").limit(most).select("doc_id")
    if not batch.join(active.select("doc_id"), "doc_id", "left_semi").isEmpty():
        raise ValueError("a document to purge is still active")
    by_version = assignments.join(batch, "doc_id", "left_semi").select("candidate_id")
    return by_version.distinct()


def orphaned_contents(deleting: DataFrame, documents: DataFrame) -> DataFrame:
    """content_hash of documents being deleted that no retained, visible document has."""
    kept = documents.where("NOT is_deleted").join(deleting.select("doc_id"), "doc_id", "left_anti").select("content_hash")
    return deleting.select("content_hash").distinct().join(kept, "content_hash", "left_anti")


def ocr_pages(documents: DataFrame, enabled: bool, most: int) -> DataFrame:
    """doc_id, page: the first pages of documents that need character recognition."""
    wanted = documents.where("status = 'ocr_required' AND page_count > 0" if enabled else "false")
    return wanted.select("doc_id", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("page_count")))).alias("page"))


def uncached_pages(pages: DataFrame, cache: DataFrame) -> DataFrame:
    keys = ["content_hash", "page", "dpi", "lang", "profile"]
    return pages.join(cache.select(*keys), keys, "left_anti")


def recognise(pages: DataFrame, engine) -> DataFrame:
    """content_hash, page, text, confidence by a pluggable engine: content, page -> (text, confidence)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [engine(c, p) for c, p in zip(part["content"], part["page"], strict=True)]
            yield pd.DataFrame({"content_hash": part["content_hash"], "page": part["page"], "text": [f[0] for f in found], "confidence": [f[1] for f in found]})

    return pages.select("content_hash", "page", "content").mapInPandas(run, "content_hash string, page int, text string, confidence double")


def combine_pages(pages: DataFrame, most: int) -> DataFrame:
    """doc_id, text, confidence: page texts in order; a document with more pages than ``most`` fails as a whole (null)."""
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    grouped = pages.groupBy("doc_id").agg(parts.alias("_parts"), F.avg("confidence").alias("_confidence"), F.count(F.lit(1)).alias("_n"))
    fits = F.col("_n") <= most
    return grouped.select("doc_id", F.when(fits, F.array_join(F.transform("_parts", lambda p: p["text"]), "\n")).alias("text"), F.when(fits, F.round("_confidence", 6)).alias("confidence"))


def audit_due_at(file_id: Column, now: Column) -> Column:
    """When a file is next read in full: in 6 hours and up to 18 more, by the end of its id."""
    spread = F.pmod(F.conv(F.right(file_id, F.lit(8)), 16, 10).cast("long"), F.lit(18 * 3600))
    return now + 6 * 3600 + spread


def changed_files(observed: DataFrame, last: DataFrame, now: int) -> DataFrame:
    """Observed files whose content has to be read: new, of other size or times, or due for audit."""
    keys = ["file_identity", "byte_size", "mtime", "ctime"]
    trusted = last.where(F.col("audit_due_at") > now).select(*keys)
    return observed.join(trusted, keys, "left_anti")

"""Sequenced changes: numbered changes of many clients, out of order, applied in order by a stateful streaming query.

A client's changes carry numbers 1, 2, 3 and so on. A change that comes too early is held until the numbers before it
have come, or until it has waited so long that these count as lost and are jumped over.

The state is keyed by bucket, and holds for a bucket a *timing wheel*, from expiry day to the lanes that hold a
change which expires then, and the lanes themselves, as columns. A lane is a client's stretch of ``span`` consecutive numbers; nearly
every client has one lane, and a client that holds a third of all rows has many, in different buckets. Each tick looks
at the slots that are due only, jumps in their lanes, and enters these at their new earliest day.

A lane decides alone what it can: which numbers it has seen, where a jump ends and how far its numbers then go without
a gap. These limits, a few a lane, tell how far the client as a whole has come: its jump goes to the highest lane that
jumped, and from there on lanes without a gap are passed. Statuses, values and gaps follow from rows and limits by joins
and windows over lanes, never over whole clients.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.llm.shared import looked_up, shared_dir, written

COLUMNS = ["change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance"]
BATCHES, FIRST_DAY, DAYS = 12, 19723, 160
#: Days after which a held change's missing predecessors count as lost.
WAIT = 3
#: Numbers in a lane, at least; and lanes' rows in a bucket and batch that one call of the processor takes together.
LEAST_SPAN, BUCKET_ROWS = 256, 4000
NEVER, ALWAYS = -(2**31) + 1000, 2**31 - 1000

FEED = "turn int, bucket int, who string, lane bigint, n bigint, day int, rid bigint, leads boolean, clock int"
TOLD = "who string, lane bigint, turn int, rid bigint, before bigint, after bigint, jumped boolean"


def numbered(changes: DataFrame) -> DataFrame:
    """Distinct rows of ``changes`` with ``who`` (the client as text), ``rid`` (a row's own number) and ``n``, the dense
    rank of its ``seq`` in its client; a null ``seq`` comes first. A null client is a client like any other.

    Rows are range-partitioned by client, seq and row, so a large client lies in many partitions; ranks within one are
    raised by what lies before, from one summary row a client and partition.
    """
    who = F.coalesce(F.concat(F.lit("="), F.col("client_id").cast("string")), F.lit(""))
    rows = changes.select(*COLUMNS).distinct().select(*COLUMNS, who.alias("who"), F.xxhash64(*COLUMNS).alias("tie"))
    placed = rows.repartitionByRange("who", "seq", "change_id", "tie").withColumns({"pid": F.spark_partition_id(), "rid": F.monotonically_increasing_id()})
    placed = written(placed, "changes")
    ranked = placed.withColumn("rank", F.dense_rank().over(Window.partitionBy("pid", "who").orderBy("seq")))
    held = placed.groupBy("pid", "who").agg(F.min(F.struct("seq")).alias("low"), F.max(F.struct("seq")).alias("high"), (F.count_distinct("seq") + F.max(F.col("seq").isNull().cast("int"))).alias("k"))
    before = Window.partitionBy("who").orderBy("pid")
    same = F.coalesce((F.lag("high").over(before)["seq"].eqNullSafe(F.col("low.seq")) & F.lag("high").over(before).isNotNull()).cast("int"), F.lit(0))
    base = held.withColumn("same", same).select("pid", "who", (F.sum(F.col("k") - F.col("same")).over(before) - F.col("k")).alias("base"))
    return ranked.join(base, ["pid", "who"]).withColumn("n", F.col("rank") + F.col("base")).drop("pid", "rank", "base")


def dated(rows: DataFrame) -> DataFrame:
    """Adds ``day`` and ``turn`` (the batch); rows without ``valid_at``, and one in eleven by its hash, vanish. A null ``change_id`` hashes as the empty text."""
    h = F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit("")).cast("binary"))
    day = F.unix_date(F.col("valid_at").cast("date")) + 9 * (h % 4)
    turn = F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((F.col("day") - FIRST_DAY) * BATCHES / F.lit(DAYS))))
    return rows.where(F.col("valid_at").isNotNull() & (h % 11 != 0)).withColumn("day", day.cast("int")).withColumn("turn", turn.cast("int"))


#: A bucket's state: the wheel (days, and the places of the lanes in each), then the lanes.
STATE = "slots array<int>, entered array<array<int>>, who array<string>, lane array<bigint>, slot array<int>, next array<bigint>, jumped array<boolean>, numbers array<array<bigint>>, days array<array<int>>"


class Wheel:
    """One bucket's lanes and the wheel over them. Tells of rows it takes, and of lanes whose limit moved."""

    def __init__(self, span: int, wait: int):
        self.span, self.wait = span, wait

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        come, clock, turn = defaultdict(list), None, None
        for part in rows:
            for who, lane, n, day, rid, at, tick in zip(part["who"], part["lane"], part["n"], part["day"], part["rid"], part["turn"], part["clock"], strict=True):
                turn = at
                if pd.isna(tick):
                    come[who, int(lane)].append((int(n), int(day), int(rid)))
                else:
                    clock = int(tick)
        slots, places, *lanes = state.get if state.exists else ([],) * len(STATE.split(", "))
        wheel, lanes = dict(zip(slots, places, strict=True)), [list(column) for column in lanes]
        at_place = {at: i for i, at in enumerate(zip(*lanes[:2], strict=True))}
        touched, told = {}, []
        for slot in sorted(day for day in wheel if clock is not None and day <= clock):
            for i in wheel.pop(slot):
                at = lanes[0][i], lanes[1][i]
                lane = touched.get(at) or self._lane(at, lanes, i)
                if lane["slot"] == slot:  # else it has been entered at an earlier day since
                    lane["slot"] = None
                    self._jump(lane, clock)
                    touched[at] = lane
        for at, changes in come.items():
            lane = touched.get(at) or self._lane(at, lanes, at_place.get(at))
            touched[at] = lane
            lane["before"] = lane["next"]
            for n, day, rid in changes:
                if n >= lane["next"] and n not in lane["held"]:
                    lane["held"][n] = day
                    told.append((*at, turn, rid, None, None, None))
            self._run(lane)
        for at, lane in touched.items():
            i = at_place.setdefault(at, len(at_place))
            if lane["held"] and (lane["slot"] is None or min(lane["held"].values()) + self.wait < lane["slot"]):
                lane["slot"] = min(lane["held"].values()) + self.wait
                wheel[lane["slot"]] = [*wheel.get(lane["slot"], []), i]
            for column, value in zip(lanes, (*at, lane["slot"], lane["next"], lane["jumped"], list(lane["held"]), list(lane["held"].values())), strict=True):
                column[i:i + 1] = [value]
            before = lane.get("before", lane["next"])
            if (lane["next"], lane["jumped"]) != lane["was"]:
                told.append((*at, turn, None, before, lane["next"], lane["jumped"]))
        if touched:
            state.update((list(wheel), list(wheel.values()), *lanes))
        yield pd.DataFrame(told, columns=["who", "lane", "turn", "rid", "before", "after", "jumped"]).astype({"rid": "Int64", "before": "Int64", "after": "Int64", "jumped": "boolean"})

    def _lane(self, at: tuple[str, int], lanes: list[list], i: int | None) -> dict:
        slot, following, jumped, numbers, days = (None, at[1] * self.span + 1, False, [], []) if i is None else (column[i] for column in lanes[2:])
        return {"slot": slot, "next": following, "jumped": jumped, "held": dict(zip(numbers, days, strict=True)), "first": at[1] == 0, "was": (following, jumped)}

    def _jump(self, lane: dict, clock: int) -> None:
        """To the last run that holds an expired change: all runs before it are jumped to one by one, with the same end."""
        last = max((n for n, day in lane["held"].items() if day + self.wait <= clock), default=None)
        if last is not None:
            lane["jumped"] = True
            lane["next"] = max(lane["next"], last + 1)
            lane["held"] = {n: day for n, day in lane["held"].items() if n > last}
            self._run(lane)

    def _run(self, lane: dict) -> None:
        """Up to the first missing number. Only the first lane knows that nothing is missing before it; others keep what they pass until it expires."""
        while lane["next"] in lane["held"]:
            if lane["first"]:
                del lane["held"][lane["next"]]
            lane["next"] += 1


def limits(told: DataFrame, span: int) -> DataFrame:
    """(who, limits): the client's next number at each batch's start, after jumps, and at its end, for all batches in turn.

    A lane's limits are carried forward over batches. The client's own is that of the first lane with a gap, from the
    highest lane that has jumped on.
    """
    points = F.sequence(F.lit(2), F.lit(2 * BATCHES + 3))
    moves = F.array_sort(F.collect_list(F.struct("turn", "before", "after", "jumped")))

    def at(t: Column) -> Column:
        past = F.filter("moves", lambda m: 2 * m["turn"] <= t)
        e = F.get(past, F.size(past) - 1)
        return F.struct(F.coalesce(F.when(2 * e["turn"] == t, e["before"]).otherwise(e["after"]), F.col("lane") * span + 1).alias("v"), F.coalesce(e["jumped"], F.lit(False)).alias("jumped"))

    lanes = told.where(F.col("rid").isNull()).groupBy("who", "lane").agg(moves.alias("moves")).select("who", "lane", F.transform(points, at).alias("points"))
    lanes = written(lanes, "lanes")
    clients = lanes.groupBy("who").agg(F.max("lane").alias("top"), F.max_by("points", "lane").alias("points"))
    short = clients.where("top = 0").select("who", F.transform("points", lambda p: p["v"]).alias("limits"))
    each = lanes.join(clients.where("top > 0").select("who"), "who", "left_semi").select("who", "lane", F.posexplode("points").alias("t", "p")).select("who", "lane", "t", "p.v", "p.jumped")
    front = each.groupBy("who", "t").agg(F.max(F.when(F.col("jumped"), F.col("lane")).otherwise(0)).alias("front"))
    end = (F.col("lane") + 1) * span + 1
    absent = each.where(F.col("v") == end).select("who", "t", (F.col("lane") + 1).alias("lane"), end.alias("v"))
    start = front.select("who", "t", F.lit(0).cast("long").alias("lane"), F.lit(1).cast("long").alias("v"))
    gaps = each.select("who", "t", "lane", "v").unionByName(absent).unionByName(start).groupBy("who", "t", "lane").agg(F.max("v").alias("v")).where(F.col("v") < end)
    first = gaps.join(front, ["who", "t"]).where(F.col("lane") >= F.col("front")).groupBy("who", "t").agg(F.min_by("v", "lane").alias("v"))
    long = first.groupBy("who").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("a")).select("who", F.transform("a", lambda p: p["v"]).alias("limits"))
    return short.unionByName(long)


def stream(spark: SparkSession, rows: DataFrame, span: int, clocks: list[int], buckets: int, wait: int) -> DataFrame:
    """Feeds ``rows`` batch by batch, and a tick a bucket with each, to the wheel; what it told. A new start for each batch, one checkpoint."""
    folder = shared_dir(spark, "sequenced")
    ticks = spark.range(buckets).select(
        F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), F.lit(c).alias("clock")) for t, c in enumerate(clocks, 1)])).alias("tick"), F.col("id").cast("int").alias("bucket")
    ).select("tick.*", "bucket")
    lane = ((F.col("n") - 1) / F.lit(span)).cast("long")
    fed = rows.withColumn("lane", lane).withColumn("bucket", F.pmod(F.xxhash64("who", "lane"), F.lit(buckets)).cast("int"))
    # Of a batch's rows with one number only the first can be taken; finding it here keeps repeats out of the shuffle to the lanes.
    heads = fed.groupBy("who", "n", "turn").agg(F.min(F.struct("day", "change_id", "tie", "rid")).alias("head")).select(F.col("head.rid").alias("rid"), F.lit(True).alias("leads"))
    fed = fed.join(heads, "rid", "left").select("turn", "bucket", "who", "lane", "n", "day", "rid", F.coalesce("leads", F.lit(False)).alias("leads"))
    names = [c.split()[0] for c in FEED.split(", ")]
    advance = Wheel(span, wait).__call__
    fed = fed.unionByName(ticks, allowMissingColumns=True).select(*names)
    fed.withColumn("batch", F.col("turn")).write.partitionBy("batch").parquet(f"{folder}/staged")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{folder}/feed"))
    settings = {
        # A RocksDB store keeps half a megabyte of an executor's memory for good, each time one is opened: by every partition at every start.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
        # Every start opens the stores anew, so none is left loaded on the executors.
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    }
    earlier = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for turn in range(1, len(clocks) + 1):
            if not files.rename(path(f"{folder}/staged/batch={turn}"), path(f"{folder}/feed/{turn}")):
                raise OSError(f"batch {turn} could not be handed over")
            source = spark.readStream.schema(FEED).parquet(f"{folder}/feed/*").where("leads OR clock IS NOT NULL")
            told = source.groupBy("bucket").applyInPandasWithState(advance, TOLD, STATE, "append", GroupStateTimeout.NoTimeout)
            query = told.writeStream.format("parquet").option("path", f"{folder}/told").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for k, v in earlier.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(TOLD).parquet(f"{folder}/told")


def running(applied: DataFrame) -> DataFrame:
    """Adds ``city`` and ``balance`` after each applied row, the numbers ``missed`` before it, and whether it is its client's last.

    Windows go over lanes; what a lane inherits comes from a summary row for each lane before it.
    """
    known = {c: F.when(F.col("op").isin("I", "D") | (F.col("op") == "U") & F.col(c).isNotNull(), F.struct(F.when(F.col("op") != "D", F.col(c)).alias("v"))) for c in ("city", "balance")}
    so_far = Window.partitionBy("who", "lane").orderBy("n")
    rows = applied.withColumns({f"set_{c}": v for c, v in known.items()})
    rows = rows.withColumns({f"own_{c}": F.last(f"set_{c}", ignorenulls=True).over(so_far) for c in known} | {"previous": F.lag("n").over(so_far)})
    ends = applied.withColumns({f"set_{c}": v for c, v in known.items()}).groupBy("who", "lane").agg(F.max("n").alias("last"), *[F.max_by(f"set_{c}", F.when(F.col(f"set_{c}").isNotNull(), F.col("n"))).alias(f"set_{c}") for c in known])
    before = Window.partitionBy("who").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        "who", "lane", F.max("last").over(before).alias("came"), (F.max("last").over(Window.partitionBy("who")) == F.col("last")).alias("tip"), F.col("last"),
        *[F.last(f"set_{c}", ignorenulls=True).over(before).alias(f"past_{c}") for c in known],
    )
    rows = rows.join(ends, ["who", "lane"])
    return rows.select(
        "rid", (F.col("n") - F.coalesce("previous", "came", F.lit(0)) - 1).alias("missed"), *[F.coalesce(f"own_{c}", f"past_{c}")["v"].alias(f"{c}_now") for c in known],
        (F.col("tip") & (F.col("n") == F.col("last")) & ~F.col("op").eqNullSafe("D")).alias("current"),
    )


def apply_changes(spark: SparkSession, changes: DataFrame, wait: int = WAIT) -> DataFrame:
    """One row per distinct change that has a day: change_id, client_id, status, batch, missed, city, cents, current.

    Order within a client is by day, then change_id, then a hash of the row. I sets city and balance, U those that it has,
    D empties both, any other ``op`` is applied and changes nothing. Null cities and balances of an I are set as such.
    Rows that differ only in columns beyond the nine known ones count as one. No rows give no rows.
    """
    rows = written(dated(numbered(changes)), "dated")
    facts = {r.turn: r for r in rows.groupBy("turn").agg(F.max("day").alias("day"), F.max("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
    if not facts:
        return rows.select("change_id", "client_id", F.col("op").alias("status"), F.col("turn").alias("batch"), F.col("n").alias("missed"), "city", F.col("n").alias("cents"), F.lit(True).alias("current"))
    span = max([LEAST_SPAN, *(int(r.n**0.5) + 1 for r in facts.values())])
    buckets = max([16, *(r.k // BUCKET_ROWS for r in facts.values())])
    clocks = [max((r.day for t, r in facts.items() if t < turn), default=NEVER) for turn in range(1, BATCHES + 1)] + [ALWAYS]
    told = stream(spark, rows, span, clocks, buckets, wait)
    taken = told.where(F.col("rid").isNotNull()).select("rid", F.lit(True).alias("taken"))
    known = looked_up(rows.join(taken, "rid", "left"), limits(told, span), "who", "rid")
    later = F.transform(F.sequence(2 * F.col("turn"), F.lit(2 * BATCHES + 3)), lambda t: F.when(F.get("limits", (t - 2).cast("int")) > F.col("n"), t))
    judged = known.withColumn("accepted", F.coalesce(F.col("taken") & (F.get("limits", 2 * F.col("turn") - 2) <= F.col("n")), F.lit(False)))
    judged = written(judged.withColumn("done", F.when(F.col("accepted"), (F.array_min(later) / 2).cast("int"))).drop("limits", "taken"), "judged")
    applied = judged.where("accepted").withColumn("lane", ((F.col("n") - 1) / F.lit(span)).cast("long"))
    out = judged.join(running(applied), "rid", "left")
    return out.select(
        "change_id", "client_id", F.when(F.col("accepted"), "applied").otherwise("rejected").alias("status"), F.coalesce("done", "turn").alias("batch"), F.coalesce("missed", F.lit(0)).cast("long").alias("missed"),
        F.col("city_now").alias("city"), F.floor(F.col("balance_now") * 100 + 0.5).cast("long").alias("cents"), F.coalesce("current", F.lit(False)).alias("current"),
    )

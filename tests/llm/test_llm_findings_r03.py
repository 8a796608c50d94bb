"""What the findings of round 3 named in the training-data operators."""

import datetime
import glob

from lodestar.llm import sequenced, shared


def test_state_of_changes_opens_no_native_stores(spark):
    """Each opening of a native store, one for every partition and start, kept memory of the executor for good."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 3, i // 3, "I", at + datetime.timedelta(days=i), "web", None, "Ilar", 1.0) for i in range(60)]
    table = spark.createDataFrame(rows, "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double")
    got = sequenced.apply_changes(spark, table)
    assert got.count() > 0
    folder = next(p for p in reversed(shared._work) if "lodestar-sequenced-" in p).removeprefix("file://")
    kept = glob.glob(f"{folder}/checkpoint/state/**/*.*", recursive=True)
    assert any(f.endswith(".delta") for f in kept) and not any(f.endswith((".changelog", ".zip")) for f in kept)

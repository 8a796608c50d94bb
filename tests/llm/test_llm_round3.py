"""Sequenced changes, spelling variants and repetition, held against plain replays on small tables."""

import datetime
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import repetition, sequenced, spelling

CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp, source string, segment string, city string, balance double"


def replayed(rows):
    """The contract, one change after another: what each row of ``rows`` comes to."""
    ranks = defaultdict(set)
    for r in rows:
        ranks[r[1]].add(r[2])
    order = lambda s: (s is not None, s or 0)
    ranks = {c: {s: i for i, s in enumerate(sorted(v, key=order), 1)} for c, v in ranks.items()}
    batches = defaultdict(list)
    for r in rows:
        h = zlib.crc32(("" if r[0] is None else str(r[0])).encode())
        if r[4] is not None and h % 11:
            day = (r[4].date() - datetime.date(1970, 1, 1)).days + 9 * (h % 4)
            batches[min(12, 1 + (day - 19723) * 12 // 160)].append((day, r[0], r))
    out, states, latest = [], {}, None

    def run(client, batch, missed):
        state = states[client]
        while state["next"] in state["held"]:
            r = state["held"].pop(state["next"])[2]
            state["next"] += 1
            if r[3] in ("I", "D"):
                state["city"], state["balance"] = (r[7], r[8]) if r[3] == "I" else (None, None)
            elif r[3] == "U":
                state["city"], state["balance"] = r[7] if r[7] is not None else state["city"], r[8] if r[8] is not None else state["balance"]
            state["last"] = len(out)
            cents = None if state["balance"] is None else math.floor(100 * state["balance"] + 0.5)
            out.append([r[0], client, "applied", batch, missed, state["city"], cents, r[3] != "D"])
            missed = 0

    for batch in range(1, 14):
        for client, state in states.items():
            while state["held"] and (batch == 13 or min(h[0] for h in state["held"].values()) + 3 <= latest):
                missed = min(state["held"]) - state["next"]
                state["next"] += missed
                run(client, batch, missed)
        for day, change, r in sorted(batches[batch], key=lambda x: x[:2]):
            state = states.setdefault(r[1], {"next": 1, "held": {}, "city": None, "balance": None, "last": None})
            n = ranks[r[1]][r[2]]
            if n < state["next"] or n in state["held"]:
                out.append([change, r[1], "rejected", batch, 0, None, None, False])
            else:
                state["held"][n] = (day, change, r)
                run(r[1], batch, 0)
        latest = max([x[0] for x in batches[batch]] + [latest if latest is not None else -1])
    final = {s["last"] for s in states.values()}
    return sorted((tuple([*o[:7], o[7] and i in final and o[2] == "applied"]) for i, o in enumerate(out)), key=str)


def test_changes_against_a_replay(spark, monkeypatch):
    """A client with half the rows in many lanes, nulls, ties of number and day, repeated rows, an unknown op, other columns."""
    monkeypatch.setattr(sequenced, "LEAST_SPAN", 8)
    r = random.Random(7)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(700):
        client = 7 if r.random() < 0.5 else r.choice([None, 1, 2, 3, 4, 5, 6, 8, 9])
        at = None if r.random() < 0.03 else start + datetime.timedelta(days=i * 120 // 700, hours=r.randrange(24))
        op = r.choice(["I", "U", "U", "U", "D", None, "X"])
        rows.append((i, client, i // 3 + r.randrange(6) if client == 7 else r.choice([None, *range(30)]), op, at, "web", None, r.choice([None, "Ilar", "Belo"]), r.choice([None, 1.005, -3.5, 10.0])))
    table = spark.createDataFrame(rows + rows[:40], CHANGES)
    clashing = table.selectExpr("*", "1 AS n", "'x' AS turn", "2 AS lane", "3 AS rid")
    got = sequenced.apply_changes(spark, clashing)
    assert got.columns == ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]
    assert sorted(map(tuple, got.collect()), key=str) == replayed(rows)


def test_no_changes(spark):
    got = sequenced.apply_changes(spark, spark.createDataFrame([(None, 1, 1, "I", None, None, None, None, None)], CHANGES))
    assert got.collect() == [] and got.columns == ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]


def test_one_edit():
    for a, b, want in (("abc", "abc", False), ("abc", "abd", True), ("abc", "ab", True), ("abc", "xabc", True), ("abcd", "acbd", False), ("aab", "ab", True), ("abc", "a", False)):
        assert spelling.one_edit(a, b) is want and spelling.one_edit(b, a) is want


def near(words):
    return {w: {v for v in words if spelling.one_edit(w, v)} for w in words}


@pytest.mark.parametrize("most", [2, 5, 2000])
def test_near_words_against_all_pairs(spark, most):
    """Long common beginnings and ends, so that small parts are cut again and again."""
    r = random.Random(3)
    words = {"".join(r.choice("ab") for _ in range(r.randint(6, 9))) for _ in range(150)} | {"prefix" * 3 + x for x in "abcé"} | {x + "suffix" * 3 for x in ("", "a", "ab", "ö")}
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in sorted(words)], "word string"), most)
    assert sorted(map(tuple, got.collect())) == sorted((w, v) for w, vs in near(words).items() for v in vs)


def test_variants_against_counting(spark):
    r = random.Random(5)
    base = ["straße", "Kolumne", "kolumnen", "kolumna", "märchen", "marchen", "kurz", "x" * 30]
    docs = [(i, " ".join(r.choice(base) for _ in range(60)) + r.choice(["", " kolumnx", "-Märchen×"])) for i in range(300)] + [(None, "kolumne " * 3), (7, None), (8, ""), (8, ""), (9, "y" * 5000)]
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
            count[word] += len(word) >= 6
    words = {w: n for w, n in count.items() if n >= 5}
    want = []
    form = {w: next(iter([v for k, v in sorted((-words[v], v) for v in vs) if -k >= 5 * words[w] and (k, v) == min((-words[u], u) for u in vs)]), None) for w, vs in near(words).items()}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        want.append((w, form[w], root, n, len(near(words)[w]), words.get(form[w])))
    got = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(form.values())
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "kurz")], "doc_id long, text string")).collect() == []


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def inside(n):
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        return {j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    out = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), sum(map(len, lines)), len(again), sum(map(len, again)), len(inside(3))]
    return out + [sum(len(words[i]) for i in inside(n)) for n in repetition.NGRAMS]


def test_repetition_against_counting(spark):
    r = random.Random(2)
    word = lambda: r.choice(["äa", "b", "c#", "d\x1c", "e\x85f", "g "])
    passage = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " \n\t\n", "a", "a b", "a b c a b c", "x\nx\n x\nx", f"{passage} and {passage}", f"{passage}\n{passage}\n" + " ".join(f"v{i}" for i in range(400)), "é" * 100_000]
    texts += ["".join(word() + r.choice([" ", "\n", "  ", "\r\n"]) for _ in range(r.randint(1, 300))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS kept")
    got = {row.doc_id: row for row in repetition.repetition(docs, "doc_id").collect()}
    for i, text in enumerate(texts):
        want = counted(text)
        assert list(got[i])[1:-2] == want, text
        failed = want[0] < 50 or 100 * want[7] > 50 * want[0]
        assert got[i].base_failed is failed and (not failed or not got[i].kept)
    # One passage twice, all there is, fails the base rule; a tenth of a long text that stands there twice is kept.
    assert not got[7].kept and got[7].base_failed and got[8].kept
    assert repetition.measure([])["n_words"].tolist() == []


def test_stages_take_maps_and_ties_in_one_order(spark, tmp_path):
    """A map column has no order; rows that agree in doc_id and text are told apart by the others."""
    import corpus_pipeline
    from lodestar.llm import mixing

    rows = [(i // 2, f"one two three four five six {i // 2} seven", "s", {"k": str(i)}, i % 3) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,string>, n int")
    kept = dict(corpus_pipeline.STAGES)["jaccard"](spark, docs, str(tmp_path)).collect()
    assert kept and {r.doc_id: r.extra["k"] for r in kept} == {r.doc_id: str(min((x for x in rows if x[0] == r.doc_id), key=lambda x: (x[0], x[1], x[2], str(x[3])))[3]["k"]) for r in kept}
    orders = [[(r.doc_id, r.n, r.extra["k"]) for r in mixing.mix(d).collect()] for d in (docs, docs.orderBy(F.desc("n"), F.desc("doc_id")).coalesce(1))]
    assert orders[0] == orders[1] and orders[0]


def test_revisits_of_a_page_that_most_share(spark):
    """The smallest page_id is the response, whatever the order, and short payloads are all responses."""
    from lodestar.llm import warc

    common, texts = "<p>" + "x" * 300_000, {}
    for i in range(60):
        texts[i] = common if i % 3 else "short" if i % 2 else None if i % 4 else f"<p>{i}" + "y" * 120
    pages = spark.createDataFrame([(i, None if i == 5 else f"http://h/{i}", t) for i, t in sorted(texts.items(), reverse=True)], "page_id long, url string, html string")
    found = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.page_records(spark, pages).collect()}
    first = {t: min(i for i in texts if texts[i] == t) for t in texts.values()}
    want = {i: ("revisit", first[t], len(t)) if t and len(t) >= 100 and first[t] != i else ("response", None, len(t or "")) for i, t in texts.items()}
    assert found == want

"""Each operator against a brute-force version, an exact round trip, or held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import decontaminate, jaccard, maintext, media, mixing, sharding, shared, tokencount, toxicity, urlfilter, warc
from lodestar.llm.components import components
from lodestar.llm.mainpages import Page
from lodestar.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def corpus(spark, n=400, seed=1):
    """Near copies around the threshold, exact copies, shared passages and short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(60)]
    rows, bases = [], [[word() for _ in range(r.randint(3, 120))] for _ in range(12)]
    for i in range(n):
        words = list(r.choice(bases))
        if r.random() < 0.3:
            words = [word() for _ in range(r.randint(0, 80))]
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            if words:
                words[r.randrange(len(words))] = word()
        if r.random() < 0.3:
            at = r.randint(0, len(words))
            words[at:at] = passage
        rows.append((i, r.choice([" ", "\n", "  "]).join(words), f"s{r.choice([0, 0, 0, 1, 2])}"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_warc_round_trip(spark):
    html = ["<p>" + "x" * 200, "<p>" + "x" * 200, "short", "short", "é" * 99, None]
    pages = spark.createDataFrame([(9 - i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    captures = {r.response.page_id: r for r in warc.round_trip(pages, payloads=True).collect()}
    for i, h in enumerate(html):
        r = captures[9 - i]
        assert r.request.page_id == r.metadata.page_id == 9 - i
        assert r.response.payload_digest == hashlib.sha256((h or "").encode()).hexdigest()
        if i != 0:
            assert r.response.record_type == "response" and bytes(r.response.payload) == (h or "").encode()
    assert captures[9].response.record_type == "revisit" and captures[9].response.refers_to == 8
    assert captures[9].metadata.payload_bytes == 203


def test_warc_keeps_outer_blanks_and_names_the_original(spark):
    page = "<p>" + "x" * 200
    pages = spark.createDataFrame([(4, " http://h/first\t ", page), (7, "http://h/again", page), (4, "http://h/tie", page)], "page_id long, url string, html string")
    found = sorted((r.page_id, r.record_type, r.refers_to, r.target_uri) for r in warc.page_records(spark, pages).collect())
    assert found == [(4, "response", None, " http://h/first\t "), (4, "response", None, "http://h/tie"), (7, "revisit", 4, "http://h/again")]
    revisit = list(warc.capture_records(7, "u", b"x", "d", 4, "0", "http://h/first"))[0]
    fields, _ = warc.parse(next(warc.members(__import__("io").BytesIO(revisit))))
    assert (fields["warc-type"], fields["warc-refers-to-target-uri"], fields["warc-refers-to-date"]) == ("revisit", "http://h/first", fields["warc-date"])


def test_warc_reads_archives_of_others(spark, tmp_path):
    """Without our own fields: no digest or one of another kind, an info record, a record that is no HTTP message."""
    record = lambda kind, name, block, *more: warc.member([("WARC-Type", kind), ("WARC-Record-ID", name), *more], block)
    whole = record("warcinfo", "<i>", b"software: x") + record("response", "<a>", b"HTTP/1.1 200 OK\r\n\r\nbody", ("WARC-Payload-Digest", "sha1:AAAA")) + record("metadata", "<m>", b"a: b", ("WARC-Concurrent-To", "<a>")) + record("response", "<b>", b"raw")
    (tmp_path / "x.warc.gz").write_bytes(whole)
    manifest = spark.createDataFrame([(str(tmp_path / "x.warc.gz"), 4, len(whole))], warc.MANIFEST)
    found = {r.capture_id: r for r in warc.assemble(warc.read_records(manifest, f"file://{tmp_path}")).collect()}
    assert set(found) == {"<a>", "<b>"} and bytes(found["<a>"].response.payload) == b"body" and bytes(found["<b>"].response.payload) == b"raw"
    assert found["<a>"].metadata.payload_bytes is None and found["<b>"].request is None


def test_warc_truncated_archive_is_an_error():
    import io

    whole = b"".join(warc.capture_records(1, "u", b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest(), None, "0"))
    assert len(list(warc.members(io.BytesIO(whole)))) == 3
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(whole[:-9])))


def test_url_rules_against_scan(tmp_path):
    r = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "net", "xa.com", "", "a.com."]
    paths = ["", "/", "/en/", "/en/x", "/e"]
    rules = [(h, p, r.choice(["allow", "block"])) for h, p in {(r.choice(hosts[:5]), r.choice(paths)) for _ in range(12)}]
    path = tmp_path / "rules"
    path.write_bytes(urlfilter.build(rules))
    parts = list(itertools.product(hosts, paths))
    found, verdicts = urlfilter.Store(str(path)).judge(parts)
    for (host, p), rule, verdict in zip(parts, found, verdicts, strict=True):
        fits = [(len(h + q), len(h), h + q, v) for h, q, v in rules if host and (host == h or host.endswith("." + h)) and p.startswith(q)]
        assert (rule, verdict) == (max(fits)[2:] if fits else (None, "allow"))


def test_url_colliding_keys(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: len(b) % 3)
    path = tmp_path / "rules"
    path.write_bytes(urlfilter.build(urlfilter.RULES))
    store = urlfilter.Store(str(path))
    assert store.judge([("www.example.com", "/en/a"), ("x.net", "/fr/"), ("x.net", "/en/")]) == (["www.example.com/en/", "net/fr/", None], ["allow", "block", "allow"])
    assert urlfilter.split_url("HTTP://WWW.Éx.com:80?q://z") == ("www.Éx.com:80", "")


def test_media_round_trip(spark):
    texts = ["", "a", "x" * 64, "ü" * 3000, "hello " * 9000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_features(docs).collect():
        data = (texts[r.doc_id] or "").encode()
        payload = media.padded(data)
        assert media.from_wav(media.to_wav(payload)) == payload and len(payload) % 64 == 0 and payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest()
        # A spectrum that only falls, as a short pulse has, is without peaks.
        assert r.feature or len(payload) == 64
    times, hashes = media.fingerprint(np.frombuffer(b"abc" * 5000, np.uint8))
    assert list(times) == sorted(times) and len(times) == len(hashes)
    # Chunks do not show in the result.
    media.CHUNK, old = 3, media.CHUNK
    assert np.array_equal(media.fingerprint(np.frombuffer(b"abc" * 5000, np.uint8))[1], hashes)
    media.CHUNK = old


def landmarks(payload):
    """The fingerprint by plain sums: frames of 512 samples every 256, a raised cosine, strongest local maxima, pairs."""
    first, second = [], []
    places = range(max(1, -(-(len(payload) - 512) // 256) + 1))
    window = [0.5 - 0.5 * np.cos(2 * np.pi * (i + 1) / 513) for i in range(512)]
    waves = np.exp(-2j * np.pi * np.outer(np.arange(257), np.arange(512)) / 512)
    for k in places:
        frame = [b - 128 for b in payload[k * 256 : k * 256 + 512]]
        level = np.abs(waves @ (np.array(frame + [0] * (512 - len(frame))) * window))
        tops = sorted((f for f in range(2, 256) if level[f] >= level[f - 1] and level[f] > level[f + 1] and level[f] >= 0.05), key=lambda f: (-level[f], f))
        first.append(tops[0] if tops else 0)
        second.append(tops[1] if len(tops) > 1 else 0)
    out = []
    for k in places:
        out += [(k, first[k] * 65536 + second[k] * 16)] * bool(first[k])
        out += [(k, first[k] * 65536 + first[k + g] * 16 + g) for g in (1, 2, 3) if k + g < len(first) and first[k] and first[k + g]]
    return ",".join(f"{t}:{h:x}" for t, h in out)


def test_media_features_by_plain_sums(spark):
    r = random.Random(11)
    texts = ["", "a", "x" * 64, "ab" * 700, *("".join(r.choice("abcdefgh éß\n") for _ in range(n)) for n in (40, 511, 512, 513, 900, 3000, 7000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in media.media_features(docs).collect():
        assert row.feature == landmarks(media.padded(texts[row.doc_id].encode())), texts[row.doc_id][:50]
    # The media column itself, stored and read back in two steps, says the same.
    steps = media.analyse_media(media.encode_media(docs)).drop("fingerprint_times", "fingerprint_hashes").collect()
    assert sorted(map(str, steps)) == sorted(map(str, media.media_features(docs).drop("feature").collect()))
    # Silence has no peaks, and samples at the edge of a frame have weight.
    assert len(media.fingerprint(np.full(4096, 128, np.uint8))[0]) == 0
    assert media._WINDOW.min() > 0


def test_sharding_brute_force(spark):
    docs, rows = corpus(spark)
    found = {r.doc_id: r for r in sharding.assign_shards(docs, 7).collect()}
    total, before = sum(len(t.encode()) + 8 for _, t, _ in rows), 0
    slots = Counter()
    for i, t, _ in sorted(rows):
        size = len(t.encode()) + 8
        shard = min(6, (2 * before + size) * 7 // (2 * total))
        assert (found[i].size, found[i].shard, found[i].slot, found[i].text_crc32) == (size, shard, slots[shard], zlib.crc32(t.encode()))
        slots[shard] += 1
        before += size


def test_stored_rows_keep_their_order(spark, tmp_path):
    """Every column stays; shards are cut in the order of the files, whatever tasks read them."""
    docs, rows = corpus(spark, 300, 8)
    docs.withColumn("extra", F.lit("x")).withColumn("size", F.lit("clash")).repartition(4, "source").write.option("parquet.block.size", 4096).parquet(str(tmp_path / "d"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    for most in ("3k", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        found.append({(r.doc_id, r.text, r.extra, r.size, r.shard, r.slot) for r in sharding.shard_stored(spark.read.parquet(str(tmp_path / "d")), 7).collect()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found[0] == found[1] and len(found[0]) == 300
    import pyarrow.parquet as pq

    stored = [(r["doc_id"], r["text"]) for p in sorted((tmp_path / "d").glob("part-*")) for r in pq.read_table(p).to_pylist()]
    total, before, slots = sum(len(t.encode()) + 8 for _, t in stored), 0, Counter()
    for i, t in stored:
        size = len(t.encode()) + 8
        shard = min(6, (2 * before + size) * 7 // (2 * total))
        assert (i, t, "x", size, shard, slots[shard]) in found[0]
        slots[shard] += 1
        before += size
    # Rows that no file holds are stored first.
    again = sharding.shard_stored(docs, 7).collect()
    assert sorted(r.doc_id for r in again) == sorted(i for i, *_ in rows) and set(again[0].asDict()) == {"doc_id", "text", "source", "size", "text_crc32", "shard", "slot"}


def test_token_counts_brute_force(spark):
    ranks = tokencount.load_ranks()
    enc = tokencount.encoder(ranks)
    docs, rows = corpus(spark, 120)
    lengths = [len(enc.encode_ordinary(t)) for _, t, _ in rows]
    suffix = tokencount.token_report(spark, docs)
    for r in suffix.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_over == sum(n > r.n_tokens for n in lengths)
        assert r.tokens_within == sum(n for n in lengths if n <= r.n_tokens)
        assert r.tokens_truncated == sum(min(n, r.n_tokens) for n in lengths)
    for r in tokencount.answer(suffix, [0, 50, 10**6]).collect():
        assert (r.docs_over, r.tokens_truncated) == (sum(n > r.context_limit for n in lengths), sum(min(n, r.context_limit) for n in lengths))
    assert isinstance(enc, tiktoken.Encoding)


def test_token_pieces_encode_as_the_whole(monkeypatch):
    enc = tokencount.encoder(tokencount.load_ranks())
    r = random.Random(5)
    monkeypatch.setattr(tokencount, "PIECE", 7)
    for _ in range(300):
        text = "".join(r.choice(["ab", "'s", " ", "  ", "\n", "9", "é", "!", "don't", " of"]) for _ in range(40))
        assert tokencount.token_length(text, enc) == len(enc.encode_ordinary(text))


def contamination(texts, items):
    """n_hit and the ids of items, by comparing every window."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall(t.translate(lower))
    out = []
    for t in texts:
        ws, hit, ids = split(t), set(), set()
        for i, item in items:
            ow = split(item)
            n = min(10, len(ow))
            for p, q in itertools.product(range(len(ow) - n + 1), range(len(ws) - n + 1)):
                if n and ow[p : p + n] == ws[q : q + n]:
                    hit.update(range(q, q + n))
                    ids.add(str(i))
        out.append((len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("block", "most", "long"), [(decontaminate.BLOCK_BYTES, 1 << 20, 0), (60, 1 << 20, 0), (60, 0, decontaminate.LONG), (60, 0, 2)])
def test_decontamination_brute_force(spark, monkeypatch, block, most, long):
    """By broadcast in one block and in many, and by shuffle, with few and with many parts of a fingerprint's documents."""
    r = random.Random(2)
    word = lambda: r.choice(["aa", "Bb", "cc", "Éé", "d9", "ee"])  # noqa: E731  few words: windows repeat
    items = [(i, " ".join(word() for _ in range(r.choice([1, 4, 9, 10, 11, 14, 30])))) for i in range(12)]
    texts = []
    for _ in range(60):
        ws = [r.choice([word(), "zz", "ff"]) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            ow = r.choice(items)[1].split()
            a = r.randint(0, len(ow))
            at = r.randint(0, len(ws))
            ws[at:at] = ow[a : a + r.randint(5, 14)]
        texts.append(r.choice([" ", ", ", "\n"]).join(ws))
    texts += [texts[0], texts[1].upper(), ""]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    monkeypatch.setattr(decontaminate, "LONG", long)
    found = decontaminate.overlaps(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256) for x in found.collect()}
    assert [got[i] for i in range(len(texts))] == contamination(texts, items)


def jaccard_components(rows):
    sets = {}
    for i, t, *_ in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_brute_force(spark, monkeypatch, seed):
    docs, rows = corpus(spark, 300, seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.with_components(docs.repartition(5)).collect()}
    assert got == jaccard_components(rows)


def test_jaccard_many_gatherings(spark):
    """Small gatherings and ranges: everything meets across tasks."""
    docs, rows = corpus(spark, 150, 9)
    old = jaccard.GATHER, jaccard.RANGE
    try:
        jaccard.RANGE = 100
        got = {r.doc_id: r.component_id for r in jaccard.with_components(docs.repartition(40)).collect()}
    finally:
        jaccard.GATHER, jaccard.RANGE = old
    assert got == {i: c for i, (_, c) in jaccard_components(rows).items()}


@pytest.mark.parametrize("span", [2_000_000, 100])
def test_jaccard_a_row_for_each_shingle(spark, monkeypatch, span):
    """The form for data so large that blobs would be next to empty gives the same."""
    docs, rows = corpus(spark, 300, 5)
    rows = [*rows, (300, None), (301, " \t"), (302, "one"), (303, "One")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[300:], "doc_id long, text string"))
    monkeypatch.setattr(jaccard, "RANGE", span)
    monkeypatch.setattr(jaccard, "LEAST_BLOB", 1 << 40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.with_components(docs.coalesce(3)).collect()}
    want = jaccard_components([(i, (t or "").lower()) for i, t, *_ in rows])
    assert got == want


@pytest.mark.parametrize("batch", [10_000, 100_000])
def test_jaccard_many_blank_rows(spark, batch):
    """More blank texts in a row than places of 16 bits, before two near copies; also in one Arrow batch."""
    words = [f"w{k}" for k in range(60)]
    near = [(70_000, " ".join(words)), (70_001, " ".join([*words[:-1], "other"]))]
    docs = spark.createDataFrame([(i, None if i % 3 else " ") for i in range(70_000)] + near, "doc_id long, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, batch)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.with_components(docs).collect()}
    finally:
        spark.conf.set(name, old)
    assert got == {i: (0, i) for i in range(70_000)} | {70_000: (56, 70_000), 70_001: (56, 70_000)}


def test_jaccard_sends_alike_again(spark):
    """A map task that runs again names and sends the same, so finished reducers fit its new output."""
    docs, _ = corpus(spark, 200, 4)
    for plain in (False, True):
        sent = [sorted((r.target, r.gathering, bytes(r.blob)) for r in jaccard.send(docs.coalesce(3), 4, plain).collect()) for _ in range(2)]
        assert sent[0] == sent[1] and len({g for _, g, _ in sent[0]}) >= 3


def test_jaccard_long_lists_in_parts(spark, monkeypatch):
    docs, rows = corpus(spark, 200, 5)
    monkeypatch.setattr(jaccard, "LONG", 3)
    got = {r.doc_id: r.component_id for r in jaccard.with_components(docs).collect()}
    assert got == {i: c for i, (_, c) in jaccard_components(rows).items()}


def test_looked_up_hot_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_KEYS", 10)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else "cold" if i % 2 else None) for i in range(300)] + [(300, "gone")], "i long, k string")
    side = spark.createDataFrame([("hot", 1), ("cold", 2), ("other", 3)], "k string, v int")
    want = sorted((r.i, r.k, {"hot": 1, "cold": 2}.get(r.k)) for r in rows.collect() if r.k) + sorted((r.i, None, None) for r in rows.collect() if not r.k)
    for nulls in (False, True):
        found = shared.looked_up(rows, side, "k", "i", nulls=nulls)
        assert sorted(map(tuple, found.collect()), key=lambda r: (r[1] is None, r)) == want
    # Both columns deal the rows, or a hot key would be in one task after all.
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = shared.looked_up(rows, side, "k", "i")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert re.search(r"hashpartitioning\(k#\d+, _salt#\d+", plan)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (101, 99), (60, 61)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(labels[i] == 0 for i in range(41)) and labels[100] == labels[101] == 99 and labels[61] == 60


def goals(sizes):
    """Shares by weight, at most three times the size, the excess shared anew until none is above."""
    free, left, out = list(range(len(sizes))), sum(sizes), [0.0] * len(sizes)
    while free:
        share = {i: left * (i % 3 + 1) / sum(j % 3 + 1 for j in free) for i in free}
        above = [i for i in free if share[i] > 3 * sizes[i]]
        for i in above or free:
            out[i] = 3.0 * sizes[i] if above else share[i]
        left -= sum(out[i] for i in above)
        free = [i for i in free if i in above] and [i for i in free if i not in above]
    return out


@pytest.mark.parametrize(("sizes", "want"), [([60, 60, 60], [30, 60, 90]), ([10, 1000, 10], [30, 960, 30]), ([0, 10], [0, 10]), ([0, 0], [0, 0]), ([], []), ([5, 1, 0, 900, 7, 7, 30, 1, 2], None)])
def test_mixing_targets(spark, sizes, want):
    want = goals(sizes) if want is None else want
    # Code points decide the order, and null is last.
    names = ["A", "B", "a", "z", "é", "日", "\U0001f600", "\U0001f601"][: max(0, len(sizes) - 1)] + [None]
    rows = spark.createDataFrame(list(zip(names, sizes, strict=False)), "source string, source_size long")
    found = {r.source: r.target for r in mixing.with_targets(rows).collect()}
    assert [found[n] for n, _ in zip(names, sizes, strict=False)] == pytest.approx(want)


def test_mixing_many_sources(spark, monkeypatch):
    """More sources than groups, most with a document or two; shards take what the tree gives them."""
    monkeypatch.setattr(mixing, "GROUPS", 7)
    docs = spark.createDataFrame([(i, f"word {i} " * (1 + i % 5), f"site{i % 600}") for i in range(1000)], "doc_id long, text string, source string")
    rows = mixing.mix_plan(docs).collect()
    assert len(rows) == 1000 and len({r.doc_id for r in rows}) == 1000
    assert all(r.taken == r.size * len(r.shards) <= 3 * r.size and len(r.keys) == len(r.shards) for r in rows)
    counts = Counter(s for r in rows for s in r.shards)
    assert sum(r.taken for r in rows) == pytest.approx(sum(r.size for r in rows), rel=0.3)
    assert len(counts) == mixing.SHARDS and max(counts.values()) < 2.5 * min(counts.values())


def test_mixing_sizes_and_targets_by_sql(spark):
    """What SQL can say of the query: size, source_size and target (no source of these tables reaches its limit)."""
    import duckdb

    sql = r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM read_parquet($f)),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source)
        SELECT doc_id, size, source_size, sum(source_size) OVER () * 1.0 FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source"""
    sizes = {r[0]: r for r in duckdb.execute(sql, {"f": f"{SMALL}/documents.parquet"}).fetchall()}
    per_source = duckdb.execute("SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) FROM read_parquet(?) GROUP BY 1 ORDER BY source NULLS LAST", [f"{SMALL}/documents.parquet"]).fetchall()
    want = dict(zip([s for s, _ in per_source], goals([int(n) for _, n in per_source]), strict=True))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in QUERIES["op8_mixing"](spark, SMALL).collect():
        assert (r.size, r.source_size) == sizes[r.doc_id][1:3] and r.target == pytest.approx(want[source[r.doc_id]])


def test_mixing(spark):
    docs, rows = corpus(spark, 1500)
    got = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    again = {r.doc_id: r.taken for r in mixing.mix_plan(docs.repartition(7)).collect()}
    taken, size, target = Counter(), Counter(), {}
    for i, t, s in rows:
        r = got[i]
        assert r.size == len(t.split()) and r.taken <= 3 * r.size and r.taken == again[i]
        taken[s] += r.taken
        size[s] += r.size
        target[s] = r.target
    for s, goal in zip(sorted(size), goals([size[s] for s in sorted(size)]), strict=True):
        assert abs(target[s] - goal) < 1e-6 and abs(taken[s] - goal) < 0.005 * goal
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert len({r.doc_id for r in got.values() if r.shards}) == len(mixed)
    assert mixed == Counter({i: r.taken // r.size for i, r in got.items() if r.size and r.taken}) + Counter({i: mixed[i] for i, r in got.items() if not r.size})


def test_splitting_tree_keeps_quotas():
    quotas = np.array([7, 0, 1000, 31])
    out = np.zeros((5, 4), np.int64)
    mixing.split_quotas(quotas, 0, 5, out)
    assert (out.sum(axis=0) == quotas).all() and abs(out.sum(axis=1) - 1038 / 5).max() <= 2


def test_crf_on_pages_it_has_not_seen():
    model = maintext.train()
    right = total = 0
    for k in range(50_000, 50_200):
        blocks = maintext.leaf_blocks(Page(k).html())
        states = maintext.decode(blocks, model)
        right += sum((b[2] or 0) == s for b, s in zip(blocks, states, strict=True))
        total += len(blocks)
    assert right / total > 0.98


def test_viterbi_is_the_best_path():
    r = random.Random(4)
    for _ in range(50):
        model = maintext.Model({f: r.uniform(-2, 2) for f in "abc"}, tuple(r.uniform(-2, 2) for _ in range(4)))
        blocks = [("", [r.choice("abcd")], None) for _ in range(7)]
        value = lambda path: sum(model.weights.get(b[1][0], 0) * s for b, s in zip(blocks, path, strict=True)) + sum(model.steps[2 * x + y] for x, y in itertools.pairwise(path))  # noqa: B023, E731
        assert abs(value(maintext.decode(blocks, model)) - max(map(value, itertools.product((0, 1), repeat=7)))) < 1e-9


def test_leaf_blocks():
    page = "<body><nav><a href='>'>x</a></nav><p>a&amp;b <b>c</b>d\n<br>e<p>f<!-- no --><script>if (a<b) '</p>'</script>g<li>h<li>i<div>j"
    assert [b[0] for b in maintext.leaf_blocks(page)] == ["x", "a&b cd e", "fg", "h", "i", "j"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>t</title><meta charset=x><body><p>First.<p>Second.", ["First.", "Second."]),
        ("<head><title>t</title><body><header>top</header><p>First.", ["top", "First."]),
        ("<head><style>p {}</style><p>No body tag.", ["No body tag."]),
        ("<head><title>t</title></head><body><p>First.", ["First."]),
        ("<p>First.<p>Icon <svg/> second.<p>Third.", ["First.", "Icon second.", "Third."]),
        ("<p>a <svg title='>' width=\"1\" /> b<p>c <svg><path d=''/><text>no</text></svg> d", ["a b", "c d"]),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</article><p>a <math/> b", ["Let x=2 be.", "a b"]),
        ("<p>a<object-x>kept</object-x><script>x</scripts>y</script>z", ["akeptz"]),
    ],
)
def test_leaf_blocks_drop_nothing_else(page, want):
    assert [b[0] for b in maintext.leaf_blocks(page)] == want


def test_leaf_blocks_take_linear_time():
    import time

    def seconds(n):
        began = time.process_time()
        found = maintext.leaf_blocks("<div class=x>text " * n + "</i>" * n + "<p><b>more " * n)
        assert len(found) == 2 * n
        return time.process_time() - began

    seconds(100)
    assert seconds(16_000) < 12 * max(0.01, seconds(4_000))


@pytest.mark.parametrize("piece", ["<a ", "</p ", "<script", "<b title='x", '<a ">"', "<script></script ", "<!-", "<svg '"])
def test_unclosed_tags_take_linear_time(piece):
    import time

    page = "<article><p>Before.</p>" + piece * ((1 << 20) // len(piece))
    for tail in ("", ">", "'>"):
        began = time.process_time()
        assert maintext.leaf_blocks(page + tail)[0][0] == "Before."
        assert time.process_time() - began < 8


def test_pieces_are_those_of_the_whole_pattern():
    for page in ("<p>a<b", "x <!-- y", "<p>a</p><script>b", "<p title='a>b'>c", "a < b > c", "<svg/>x<svg>y</svg>z<", "<p>q</p>r <!-- s", ""):
        want = "".join(m["text"] or "" for m in maintext._TOKEN.finditer(page))
        assert "".join(m if isinstance(m, str) else m["text"] or "" for m in maintext.pieces(page)) == want


def toxic_rows(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "ce", "di", "fo", "gu", "ne", "st"]) for _ in range(r.randint(1, 3)))
    rows = []
    for i in range(n):
        bad = r.random() < 0.2
        ws = [r.choice(["vileword", "zornix" + word(), "scoundrel"]) if bad and r.random() < 0.04 else word() for _ in range(r.randint(40, 300))]
        rows.append((i, " ".join(ws), int(any(w in ("vileword", "scoundrel") or w.startswith("zornix") for w in ws))))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows(900, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", F.lit(0).alias("quality"), "toxic")
    found = {r.doc_id: r for r in toxicity.score_documents(docs.drop("toxic"), labels).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (i in held) for i in truth)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    assert sum(found[i].predicted == truth[i] for i in held) / len(held) > 0.93


def test_toxicity_ignores_held_out_labels(spark):
    rows = toxic_rows(300, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_toxicity_learns_a_large_lexicon():
    """Markers of more than 1024 bytes together, some beyond ASCII: most are learnt, though rows were kept by windows only."""
    r = random.Random(7)
    word = lambda: "".join(r.choice(["ba", "ce", "di", "fo", "gu", "ne", "st"]) for _ in range(3))
    markers = ["".join(r.choice(letters) for _ in range(9)) for letters in ["hjklmvx", "pqrwxyz", "бгджзйк"] for _ in range(80)]
    rows = [(" ".join(r.choice(markers) if y and r.random() < 0.2 else word() for _ in range(60)), y) for y in [0] * 600 + [1] * 600]
    scorer = toxicity.Scorer(toxicity.train(rows))
    assert sum(scorer.score(" ".join([m] * 40)) >= 0.5 for m in markers) > 0.9 * len(markers)
    assert all(scorer.score(" ".join(word() for _ in range(60))) < 0.5 for _ in range(50))


def test_toxicity_dictionaries_are_separate_and_trained(monkeypatch):
    """Both dictionaries come from the trainer, the ordinary one from ordinary rows only, with windows of all of them."""
    made = []
    real = toxicity.trained
    monkeypatch.setattr(toxicity, "trained", lambda samples, size: made.append((samples, real(samples, size))) or made[-1][1])
    model = toxicity.train([(t, y) for _, t, y in toxic_rows(300, 3)])
    plain = {w for _, t, y in toxic_rows(300, 3) if not y for w in toxicity.windows(toxicity.tokens(t))}
    assert model.toxic in {content for _, content in made}
    whole = next(content for samples, content in made if len(samples) > len(plain) // 2 and set(samples) <= plain)
    assert model.ordinary.endswith(whole) and not any(m in model.ordinary for m in (b"vileword", b"zornix", b"scoundrel"))


def test_toxicity_reaches_all_of_the_dictionary():
    r = random.Random(8)
    pieces = sorted(" " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(11)) for _ in range(max(toxicity.TOXIC_BYTES) // 12))
    scorer = toxicity.Scorer(toxicity.Model(1.0, 1, b" ordinary", "".join(pieces).encode()))
    assert all(scorer.raw(" ".join([p] * 6)) > 0 for p in pieces[:: len(pieces) // 50])


def test_toxicity_threshold_and_ranking():
    toxic, ordinary = np.array([3.0, 2.0, 0.0]), np.array([2.0, 0.5, 0.0, 0.0])
    assert toxicity.ranking(toxic, ordinary) == sum((a > b) + (a == b) / 2 for a in toxic for b in ordinary) / 12
    # All above 0.5 are taken: two hits of three, one wrong; the threshold lies between 2 and 0.5.
    assert toxicity.best_threshold(toxic, ordinary) in (1.25, 2.5)
    assert toxicity.best_threshold(np.array([0.0]), np.array([0.0])) == 1.0


def test_toxicity_score_at_the_threshold_is_toxic():
    model = toxicity.Model(1.0, 1, b" ordinary", b" vileword nonsense ")
    raw = toxicity.Scorer(model).raw("vileword nonsense " * 30)
    assert toxicity.Scorer(model._replace(threshold=raw)).score("vileword nonsense " * 30) == 0.5
    assert toxicity.Scorer(model).score(None) == toxicity.Scorer(model).score("") == 0.0


def test_toxicity_sample_is_bounded_by_rows(spark, monkeypatch):
    """A doc_id that repeats does not enlarge the sample."""
    monkeypatch.setattr(toxicity, "TRAIN_ORDINARY", 5)
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(40)] + [(i, "other") for i in range(2, 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(12)], "doc_id long, toxic int")
    assert len(toxicity.training_rows(docs, labels)) == 5


def test_pipeline_stages_brute_force(spark, tmp_path):
    docs, rows = corpus(spark, 250, 6)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    item = next(t for _, t, _ in rows if len(t.split()) > 40)
    spark.createDataFrame([(1, " ".join(item.split()[:12]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 0, int(i % 50 == 0)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    near = {r.doc_id for r in stages["jaccard"](spark, docs, folder).collect()}
    assert near == {c for _, c in jaccard_components(rows).values()}
    clean = {r.doc_id for r in stages["decontaminate"](spark, docs, folder).collect()}
    hits = contamination([t for _, t, _ in rows], [(1, " ".join(item.split()[:12]))])
    assert clean == {i for (i, *_), h in zip(rows, hits, strict=True) if not h[1]}
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert {r.doc_id for r in stages["toxicity"](spark, docs, folder).collect()} == {i for i, s in scores.items() if s < 0.5}
    out = corpus_pipeline.run(spark, folder).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("name", QUERIES)
def test_queries_run(spark, name):
    import duckdb

    df = QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in ORACLE_SQL:
        db = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        want = db.execute(ORACLE_SQL[name])
        assert [d[0] for d in want.description] == df.columns
        assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))

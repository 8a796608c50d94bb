"""Toxicity by compression distance.

Two zstandard dictionaries are trained by zstandard's own trainer, one on windows of ordinary text and one on windows of
toxic text. A text is cut into windows of WINDOW_WORDS words; each is compressed with either dictionary, and the bytes
that the toxic one saves beyond a margin are added up. The sum per window is held against a calibrated threshold.

Most windows of a toxic text are ordinary, so the toxic dictionary is trained on those that are not. Which these are is
found by cross-fitting: the labelled rows are dealt over FOLDS, and a window of one fold is kept if dictionaries trained
on the other folds compress it better with the toxic one than all but a few windows of ordinary rows. So a window counts
only for content that recurs in toxic rows it does not come from. The kept windows train the next round's toxic
dictionary; ordinary windows that save almost as much train a second part of the ordinary one, beside the part trained
on all ordinary windows.
The round, the size of the dictionary and the margin are those that rank the rows of the folds best, each scored by
dictionaries that have not seen it; the threshold is calibrated on the same scores. No row outside the training fold
has a part in any of it.

Windows are so short that zstandard would store many of them raw. So a fixed carrier precedes each window; both
dictionaries end with it, it always compresses, and the lengths differ by what the window itself saves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.media import sliced

#: The training sample holds at most so many labelled rows of each class, and of texts up to TRAIN_BYTES: 98 MB.
TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_BYTES = 1500, 4500, 16_384
WINDOW_WORDS = 2
#: A window of long words is compressed in parts of this size.
WINDOW_BYTES = 256
#: Windows added to every text, so that short ones need more than one hit's chance.
PRIOR_WINDOWS = 12
FOLDS, ROUNDS = 4, 4
#: Bytes of the ordinary dictionary (as is the first toxic one) and of its part from hard windows. Of the toxic one's
#: sizes the first is that of the rounds, the others are tried after the last.
ORDINARY_BYTES, HARD_BYTES, TOXIC_BYTES = 8192, 2048, (2048, 1024, 4096, 8192)
#: Ordinary windows are hard if they save more than kept ones must, less so many bytes.
HARD = 2
#: Segment and d-mer of the trainer, and the shortest match.
SEGMENT, DMER, MATCH = 32, 6, 4
#: Of ordinary windows, the share that may do better with the toxic dictionary than a window that is kept.
CHANCE = 0.01
MARGINS = (1, 2, 3)
CARRIER = hashlib.sha512(b"carrier").digest()
#: Windows whose saving a worker remembers.
REMEMBERED = 200_000
_scorers: dict[bytes, Scorer] = {}


class Model(NamedTuple):
    """What is sent to the workers; a blank toxic dictionary scores every text 0."""

    threshold: float
    margin: int
    ordinary: bytes
    toxic: bytes


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def windows(words: list[bytes]) -> Iterator[bytes]:
    """Runs of WINDOW_WORDS words, together all of the text, between blanks."""
    for i in range(0, len(words), WINDOW_WORDS):
        window = b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" "
        if len(window) <= WINDOW_BYTES:
            yield window
        else:
            for at in range(0, len(window), WINDOW_BYTES):
                yield window[at : at + WINDOW_BYTES]


def unlike(texts: list[list[bytes]]) -> list[list[bytes]]:
    """The texts without copies and near copies of earlier ones, whose words would seem to recur."""
    seen: set[int] = set()
    kept = []
    for words in texts:
        grams = {g for i in range(max(1, len(words) - 3)) if (g := zlib.crc32(b" ".join(words[i : i + 4]))) % 4 == 0}
        if 10 * len(grams & seen) <= 2 * len(grams):
            kept.append(words)
        seen |= grams
    return kept


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on ``samples``, ``size`` bytes at most."""
    try:
        content = zstandard.train_dictionary(size + 512, samples, k=SEGMENT, d=DMER).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the samples themselves
        content = b"".join(samples)
    return content[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Compression after a dictionary with this content and the carrier, all of it within reach."""
    log = max(15, (2 * (len(content) + len(CARRIER) + WINDOW_BYTES)).bit_length())
    rules = zstandard.ZstdCompressionParameters(window_log=log, hash_log=log, chain_log=log, search_log=5, min_match=MATCH, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    base = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    base.precompute_compress(compression_params=rules)
    return zstandard.ZstdCompressor(dict_data=base, compression_params=rules)


def lengths(found: list[bytes], content: bytes) -> np.ndarray:
    """Compressed length of each window."""
    compress = compressor(content).compress
    return np.fromiter((len(compress(CARRIER + w)) for w in found), np.int64, len(found))


class Scorer:
    """Scores texts by a model; remembers the savings of windows met before."""

    def __init__(self, model: Model):
        self.model, self.gains = model, {}
        self.plain, self.toxic = compressor(model.ordinary).compress, compressor(model.toxic).compress

    def raw(self, text: str | None) -> float:
        """Bytes saved beyond the margin, per window."""
        if not self.model.toxic:
            return 0.0
        n, saved, gains, margin = 0, 0, self.gains, self.model.margin
        for window in windows(tokens(text)):
            n += 1
            gain = gains.get(window)
            if gain is None:
                if len(gains) >= REMEMBERED:
                    gains.clear()
                carried = CARRIER + window
                gain = gains[window] = max(0, len(self.plain(carried)) - len(self.toxic(carried)) - margin)
            saved += gain
        return saved / (n + PRIOR_WINDOWS)

    def score(self, text: str | None) -> float:
        raw = self.raw(text)
        return raw / (raw + self.model.threshold) if raw else 0.0


class Fold:
    """The windows of some rows of one class, and to which row each belongs."""

    def __init__(self, texts: list[list[bytes]]):
        cut = [list(windows(words)) for words in texts]
        self.windows = [w for c in cut for w in c]
        self.counts = np.array([len(c) for c in cut], np.int64)
        self.row = np.repeat(np.arange(len(cut)), self.counts)

    def raw(self, gains: np.ndarray, margin: int) -> np.ndarray:
        return np.bincount(self.row, np.maximum(gains - margin, 0), len(self.counts)) / (self.counts + PRIOR_WINDOWS)


def ranking(toxic: np.ndarray, ordinary: np.ndarray) -> float:
    """How often a toxic row has the higher value (ties count half)."""
    values = np.sort(ordinary)
    return float((np.searchsorted(values, toxic, "left") + np.searchsorted(values, toxic, "right")).mean() / 2 / len(values))


def best_threshold(toxic: np.ndarray, ordinary: np.ndarray) -> float:
    """Between the values where taking all above has the best F1."""
    values = np.unique(np.concatenate([toxic, ordinary]))[::-1]
    best = (0.0, float(values[0]) or 1.0)
    a, b = np.sort(toxic), np.sort(ordinary)
    hits, wrong = len(a) - np.searchsorted(a, values), len(b) - np.searchsorted(b, values)
    for k, value in enumerate(values):
        if value > 0:
            below = values[k + 1] if k + 1 < len(values) else 0.0
            best = max(best, (2 * hits[k] / (hits[k] + wrong[k] + len(a)), (value + below) / 2))
    return float(best[1])


def train(rows: list[tuple[str, int]]) -> Model:
    """The model of labelled texts. Fewer than FOLDS unlike rows of a class leave nothing to compare: a blank model."""
    split = {k: unlike([w for t, y in rows if y == k and (w := tokens(t))]) for k in (0, 1)}
    ordinary = trained([w for words in split[0] for w in windows(words)] or [b" "], ORDINARY_BYTES)
    blank = Model(1.0, 1, ordinary, b"")
    if min(map(len, split.values())) < FOLDS:
        return blank
    toxic, plain = ([Fold(split[k][f::FOLDS]) for f in range(FOLDS)] for k in (1, 0))
    of_others = lambda parts, f: [w for g in range(FOLDS) if g != f for w in parts[g]]
    base = [trained(of_others([p.windows for p in plain], f), ORDINARY_BYTES) for f in range(FOLDS)]
    kept, hard, best = [p.windows for p in toxic], None, (0.0, blank)
    for k in range(ROUNDS + 1):
        against = [(b"" if hard is None else trained(of_others(hard, f), HARD_BYTES)) + base[f] for f in range(FOLDS)]
        before = [(lengths(toxic[f].windows, against[f]), lengths(plain[f].windows, against[f])) for f in range(FOLDS)]
        usual = None
        # The first toxic dictionary knows no choice of windows yet and is as large as the ordinary one.
        for size in (ORDINARY_BYTES,) if k == 0 else TOXIC_BYTES:
            gains = []
            for f in range(FOLDS):
                content = trained(of_others(kept, f), size)
                gains.append((before[f][0] - lengths(toxic[f].windows, content), before[f][1] - lengths(plain[f].windows, content)))
            usual = usual or gains
            for margin in MARGINS:
                of_toxic, of_plain = (np.concatenate([part[f].raw(gains[f][side], margin) for f in range(FOLDS)]) for side, part in ((0, toxic), (1, plain)))
                rank = ranking(of_toxic, of_plain)
                if rank > best[0]:
                    against_all = (b"" if hard is None else trained([w for part in hard for w in part], HARD_BYTES)) + ordinary
                    best = rank, Model(best_threshold(of_toxic, of_plain), margin, against_all, trained([w for part in kept for w in part], size))
            if k < ROUNDS:
                break
        least = np.quantile(np.concatenate([g[1] for g in usual]), 1 - CHANCE)
        kept = [[w for w, gain in zip(toxic[f].windows, usual[f][0], strict=True) if gain > least] for f in range(FOLDS)]
        hard = [[w for w, gain in zip(plain[f].windows, usual[f][1], strict=True) if gain > max(least - HARD, 1)] for f in range(FOLDS)]
        if sum(map(bool, kept)) < 2:
            break
    return best[1]


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The bounded sample: of labelled rows outside the held-out fold, those that come first by a hash of id and text.

    The bound counts rows of ``docs`` after the join, so a doc_id that repeats does not enlarge it.
    """
    known = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    order = F.xxhash64("doc_id")
    picked = None
    for toxic, most in ((1, TRAIN_TOXIC), (0, TRAIN_ORDINARY)):
        some = known.where(F.col("toxic") == toxic).orderBy(order, "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    # At most TRAIN_TOXIC + TRAIN_ORDINARY rows of two numbers are broadcast.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    found = texts.join(F.broadcast(picked), "doc_id")
    rows = [r for toxic, most in ((1, TRAIN_TOXIC), (0, TRAIN_ORDINARY)) for r in found.where(F.col("toxic") == toxic).orderBy(order, "doc_id", "text").limit(most).collect()]
    return [(r.text, int(r.toxic)) for r in sorted(rows, key=lambda r: (r.doc_id, r.text, r.toxic))]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(training_rows(docs, labels))


def with_score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``score`` of every row; a null or empty text scores 0. Narrow, whole texts."""
    key = hashlib.sha256(repr(model).encode()).digest()
    plain = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    text = "_text" if "_text" not in keep else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers[key] = Scorer(model)
        score = _scorers[key].score
        for whole in batches:
            for batch in sliced(whole, text):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([score(t.as_py()) for t in batch.column(text)], pa.float64())], [*keep, "score"])

    return docs.select(*keep, F.col("text").cast("string").alias(text)).mapInArrow(run, f"{plain}score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    With fewer than FOLDS unlike training rows of a class nothing sets toxic text apart and every score is 0. A null
    doc_id is not held out. A score of exactly 0.5 is toxic. A doc_id that labels mark both ways trains as both.
    Repeated rows score alike; columns other than doc_id and text are ignored.
    """
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels), "doc_id")
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

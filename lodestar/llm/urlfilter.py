"""URL rules in a sorted digest array.

The store of a rule list is four arrays in one file: the 64-bit xxHash keys in ascending order, the offsets of the
full rule strings, the strings, and the verdicts. Tasks memory-map the file, so all workers of a machine share its
pages and no heap grows with the list. A batch of URLs makes its candidate strings, one shape (number of host labels,
length of path) at a time, hashes them, finds them with one vectorised binary search, and compares the full stored
string of each hit, so colliding keys cannot decide.
"""

from __future__ import annotations

import os
import re
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.shared import shared_dir

#: The rules of the contract: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
VERDICTS = ("allow", "block")
#: A URL that no key of the array covers is not on the list.
DEFAULT_VERDICT = "allow"
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = {c: c + 32 for c in range(65, 91)}
_maps: dict[str, Store] = {}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The file of a rule list. Of rules that repeat a host and path, the last verdict holds."""
    verdicts = {host.translate(_LOWER) + path: (host.count(".") + 1, len(path), VERDICTS.index(v)) for host, path, v in rules}
    entries = sorted((xxhash.xxh64_intdigest(s.encode()), s.encode(), *verdicts[s]) for s in verdicts)
    shapes = sorted({(e[2], e[3]) for e in entries})
    blob = b"".join(e[1] for e in entries)
    ends = np.cumsum([0, *(len(e[1]) for e in entries)]).astype("<u8")
    keys = np.array([e[0] for e in entries], "<u8")
    return struct.pack("<QQQ", len(entries), len(shapes), len(blob)) + keys.tobytes() + ends.tobytes() + np.array(shapes, "<u8").tobytes() + bytes(e[4] for e in entries) + blob


class Store:
    """A memory-mapped rule list."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n, shapes, _ = struct.unpack("<QQQ", bytes(data[:24]))
        at = 24
        self.keys = data[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = data[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.shapes = [tuple(map(int, s)) for s in data[at : at + 16 * shapes].view("<u8").reshape(-1, 2)]
        at += 16 * shapes
        self.verdicts = data[at : at + n]
        self.blob = data[at + n :]

    def text(self, k: int) -> bytes:
        return self.blob[int(self.ends[k]) : int(self.ends[k + 1])].tobytes()

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """The entry of each candidate, or -1."""
        found = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return found
        keys = np.fromiter((xxhash.xxh64_intdigest(c) for c in candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        for i in hit:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:  # entries with one key stand side by side
                if self.text(k) == candidates[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def judge(self, parts: list[tuple[str, str]]) -> tuple[list[str | None], list[str]]:
        """Rule and verdict of each (host, path); of rules that fit, the longest, then the one with the longer host."""
        best: list[tuple[int, int, int] | None] = [None] * len(parts)
        labels = [host.split(".") for host, _ in parts]
        for depth, length in self.shapes:
            rows = [i for i, (h, p) in enumerate(parts) if len(labels[i]) >= depth and len(p) >= length and h]
            hosts = [".".join(labels[i][-depth:]) for i in rows]
            found = self.probe([(h + parts[i][1][:length]).encode("utf-8", "surrogatepass") for h, i in zip(hosts, rows, strict=True)])
            for j in np.flatnonzero(found >= 0):
                rank = (len(hosts[j]) + length, len(hosts[j]), int(found[j]))
                if best[rows[j]] is None or rank > best[rows[j]]:
                    best[rows[j]] = rank
        rules = [None if b is None else self.text(b[2]).decode() for b in best]
        return rules, [DEFAULT_VERDICT if b is None else VERDICTS[self.verdicts[b[2]]] for b in best]


def publish(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Writes the file to the shared folder; returns its URI."""
    folder = shared_dir(spark, "urlrules")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/rules.bin") as out:
        out.write(build(rules))
    return f"{folder}/rules.bin"


def opened(uri: str) -> Store:
    """The store at ``uri``, mapped once a worker. A file of another file system is fetched, mapped and unlinked."""
    if uri not in _maps:
        files, path = fs.FileSystem.from_uri(uri)
        if isinstance(files, fs.LocalFileSystem):
            _maps[uri] = Store(path)
        else:
            handle, local = tempfile.mkstemp()
            with os.fdopen(handle, "wb") as out, files.open_input_stream(path) as source:
                while chunk := source.read(1 << 20):
                    out.write(chunk)
            _maps[uri] = Store(local)
            os.unlink(local)
    return _maps[uri]


def judge_urls(rows: DataFrame, uri: str, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, rule and verdict of every row. Narrow, without a shuffle.

    A null or malformed url has empty host and path, which no rule fits. Repeated rows are judged alike; columns other
    than the two named are neither read nor returned.
    """
    source = rows.select(F.col(key), F.col(url).cast("string").alias("_url"))
    schema = f"{key} {source.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = opened(uri)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            rule, verdict = store.judge(parts)
            columns = [batch.column(0), *(pa.array(c, pa.string()) for c in ([p[0] for p in parts], [p[1] for p in parts], rule, verdict))]
            yield pa.RecordBatch.from_arrays(columns, [key, "host", "path", "rule", "verdict"])

    return source.mapInArrow(run, schema)

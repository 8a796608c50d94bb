"""Identities: digests of contents and of whole projections, keyed contact hashes, typed ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.vectorised import vectorised


def content_digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def framed(*parts: Column) -> Column:
    """Parts, each after its byte length, so that no two lists of parts give the same bytes."""
    return F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])


def version_id(*parts: Column) -> Column:
    return F.concat(F.lit("ver_"), F.substring(F.sha2(framed(*parts), 256), 1, 32))


def is_typed_id(c: Column, kind: str) -> Column:
    return c.rlike(f"^{kind}_[0-9a-f]{{32}}$")


def projection_digest(projection: DataFrame) -> DataFrame:
    """One row: digest of all (doc_id, version_id), whatever their order, their number, and repeated documents.

    Rows are hashed where they are and the hashes added up in lanes of 16 bits, so nothing is sorted or gathered and a sum
    is exact up to 1.4e14 rows. ``repeated`` is the number of documents that occur twice; such a projection is invalid.
    """
    h = F.sha2(framed(F.col("doc_id").cast("string"), F.col("version_id").cast("string")), 256)
    lanes = [F.sum(F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("long")).alias(f"lane{i}") for i in range(16)]
    whole = projection.agg(F.count(F.lit(1)).alias("members"), *lanes)
    repeated = projection.groupBy("doc_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated"))
    return whole.crossJoin(F.broadcast(repeated)).select("members", "repeated", F.sha2(F.concat_ws(",", *[f"lane{i}" for i in range(16)]), 256).alias("digest"))


def contact_hash(key: bytes, kind: str):
    """HMAC-SHA256 of a contact under ``key``; e-mails and phones never share a hash.

    The standard's two nested digests, of the key's pads and the message, as column expressions.
    """
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    message = F.lit(f"{kind}\0".encode())
    return lambda value: F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message, F.encode(value, "UTF-8")), 256))), 256)


def fnv1a(data: bytes, seed: int = 0xCBF29CE484222325) -> int:
    """The published 64-bit FNV-1a hash."""
    for byte in data:
        seed = ((seed ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return seed


@vectorised("string")
def quick_fingerprint(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Fingerprint of (size, modified, content): all of a content up to 8 KiB, else its first and last 4 KiB."""
    for sizes, times, contents in parts:
        out = []
        for size, time, content in zip(sizes, times, contents, strict=True):
            data = content if len(content) <= 8192 else content[:4096] + content[-4096:]
            out.append(f"{fnv1a(b'quick' + int(size).to_bytes(8, 'little') + int(time).to_bytes(8, 'little', signed=True) + data):016x}")
        yield pd.Series(out)

"""Text functions as column expressions: they stay in the JVM and inside code generation.

Lengths that a rule gives in bytes are UTF-8 bytes here too (``octet_length``). Patterns name their character classes,
since Java's ``\\b``, ``\\d`` and ``\\w`` are ASCII by default.
"""

from __future__ import annotations

import array
import collections
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of Unicode except line ends, as a Java class; control characters count as blanks.
_HORIZONTAL = r"[\p{Z}\x{0}-\x{9}\x{B}\x{E}-\x{1F}\x{7F}-\x{9F}]+"
#: The same and line ends for Python: white space, controls and separators, all below U+3001.
_WORDS = re.compile("[^" + "".join(re.escape(chr(c)) for c in range(0x3001) if chr(c).isspace() or unicodedata.category(chr(c)) in ("Cc", "Zs", "Zl", "Zp")) + "]+")
_LINE_ENDS, _SPACED = re.compile("(\r\n|[\r\n\f])"), re.compile("[A-Za-z]( [A-Za-z]){3,}")
SHORT_LINE_BYTES = 80
SNIPPET_BEFORE, SNIPPET_AFTER = 40, 80
FILE_NAME_BYTES = 160
DETAIL_CHARS = 120


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, UPPER, LOWER)


def folded(c: Column) -> Column:
    """White space runs to one blank, trimmed, ASCII lower case: the key that values are compared by."""
    return ascii_lower(F.trim(F.regexp_replace(c, r"[\p{Z}\s\x{85}]+", " ")))


def fold_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\p{Z}\s\x{85}]+", " "))


def text_lines(c: Column) -> Column:
    """Lines of a text; CR, LF, CR LF and form feed each end one."""
    return F.split(c, r"\r\n|[\r\n\f]", -1)


def tidy_line(line: Column) -> Column:
    """One blank for each run of horizontal space or control characters; spaced-out words are put together."""
    plain = F.trim(F.regexp_replace(line, _HORIZONTAL, " "))
    return let(plain, lambda x: F.when(x.rlike(r"^[A-Za-z]( [A-Za-z]){3,}$"), F.replace(x, F.lit(" "), F.lit(""))).otherwise(x))


def is_page_number(line: Column) -> Column:
    low = ascii_lower(line)
    return low.startswith("page ") & low.contains(" of ") & low.rlike("[0-9]")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever ``body`` uses it.

    A lambda that captures an expression would compute it for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def repeated(lines: Column) -> Column:
    """The short lines that occur more than once: equal ones stand side by side in the sorted array."""
    short = F.array_sort(F.filter(lines, lambda x: (x != "") & (F.octet_length(x) <= SHORT_LINE_BYTES)))
    none = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("twice"))

    def step(held: Column, line: Column) -> Column:
        new = (line == held["last"]) & ~F.coalesce(F.try_element_at(held["twice"], F.lit(-1)) == line, F.lit(False))
        return F.struct(line.alias("last"), F.when(new, F.concat(held["twice"], F.array(line))).otherwise(held["twice"]).alias("twice"))

    return F.aggregate(short, none, step)["twice"]


def normalize_text(c: Column) -> Column:
    """Tidy lines without page numbers, repeated short lines (all copies go) and surplus blank lines."""

    def cleaned(lines: Column) -> Column:
        return let(repeated(lines), lambda twice: F.transform(lines, lambda x: F.when(is_page_number(x) | F.array_contains(twice, x), "").otherwise(x)))

    joined = F.array_join(let(F.transform(text_lines(c), tidy_line), cleaned), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def language_set(c: Column) -> Column:
    """``en`` for an ASCII letter, ``zh`` for a Han character, in this order; else ``unknown``."""
    found = F.array_compact(F.array(F.when(c.rlike("[A-Za-z]"), "en"), F.when(c.rlike(r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"), "zh")))
    return F.when(F.size(found) == 0, F.array(F.lit("unknown"))).otherwise(found)


# Contact and path patterns and what replaces them, in order of application.
REDACTIONS = (
    (r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9_])", "<redacted-email>"),
    (r"(?U)(?:\+\d{1,3}[\s.-]*)?(?:\(\d{3}\)[\s.-]*|\d{3,4}[\s.-]+)\d{3,4}[\s.-]*\d{4}", "<redacted-phone>"),
    (r"(?U)\+?(?:1)?\d{10}\b", "<redacted-phone>"),
    (r"(?iU)\b(?:wechat|weixin|wx|微信|微信号)\s*[:：]\s*[A-Za-z][A-Za-z0-9_.-]{5,31}\b", "<redacted-wechat>"),
    (r"(?iU)(?:file://\S+|(?:~|/Users|/home|/private|/var|/tmp|[A-Z]:[\\/])\S*|\b[A-Z]:\\\S+|\S*(?:/Users/|/home/|/private|\\Users\\)\S*)", "<redacted-path>"),
)


def redact(c: Column) -> Column:
    """Contacts and local paths replaced; a text without ``@``, digit, ``:``, ``/``, ``~`` or ``\\`` is not searched."""
    out = c
    for pattern, with_ in REDACTIONS:
        out = F.regexp_replace(out, pattern, with_)
    return F.when(c.rlike(r"[@0-9０-９:：/~\\]|\p{Nd}"), out).otherwise(c)


def cut_bytes(c: Column, most: int) -> Column:
    """At most ``most`` bytes, cut between characters and marked by ``...`` if shortened.

    A prefix of characters is chosen by the bytes of its end, so nothing is decoded half.
    """
    room = most - 3
    # Characters have 1 to 4 bytes: the longest prefix of at most room characters that fits.
    ends = F.sequence(F.lit(room), F.lit(room // 4), F.lit(-1))
    fit = lambda x: F.element_at(F.filter(ends, lambda n: F.octet_length(F.substring(x, F.lit(1), n)) <= room), 1)
    return let(c, lambda x: F.when(F.octet_length(x) <= most, x).otherwise(F.concat(F.substring(x, F.lit(1), fit(x)), F.lit("..."))))


def file_name_shown(c: Column) -> Column:
    return cut_bytes(redact(fold_space(c)), FILE_NAME_BYTES)


def detail_value(raw: Column, normalized: Column, confidence: Column) -> tuple[Column, Column]:
    """The value shown for a field and its confidence between 0 and 1."""
    value = redact(fold_space(F.coalesce(F.when(F.trim(normalized) != "", normalized), raw)))
    shown = F.when(F.length(value) > DETAIL_CHARS, F.concat(F.substring(value, 1, DETAIL_CHARS), F.lit("..."))).otherwise(value)
    return shown, F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def snippet(text: Column, terms: Column) -> Column:
    """Text around the first of ``terms`` that occurs, redacted. Offsets are characters."""
    places = let(ascii_lower(text), lambda low: F.filter(F.transform(terms, lambda t: F.instr(low, ascii_lower(t))), lambda p: p > 0))
    at = F.coalesce(F.get(places, 0), F.lit(1))
    start = F.greatest(F.lit(1), at - SNIPPET_BEFORE)
    return redact(F.trim(F.substring(text, start, at + SNIPPET_AFTER - start)))


def page_of_text(text: Column, offset: Column | int, limit: Column | int) -> Column:
    """Characters [offset, offset + limit) with the total and the next cursor; null beyond the end."""
    offset, limit = (F.lit(x) if isinstance(x, int) else x for x in (offset, limit))
    total = F.length(text)
    next_ = offset + limit
    page = F.struct(F.substring(text, offset + 1, limit).alias("text"), total.alias("total"), F.when(next_ < total, next_).alias("next_cursor"))
    return F.when((offset >= 0) & (offset <= total), page)


def page_of_bytes(text: Column, offset: Column, limit: Column) -> Column:
    """Bytes [offset, offset + limit) of a text, the end moved back to a character boundary. Null inside a character."""

    def of(data: Column) -> Column:
        # A byte that goes on with a character has the bits 10 first.
        inside = lambda at: F.hex(F.substring(data, at + 1, F.lit(1))).rlike("^[89AB]")
        size = F.octet_length(data)
        wanted = F.least(size, offset + limit)
        starts = [F.when((wanted - k <= offset) | (wanted - k >= size) | ~inside(wanted - k), wanted - k) for k in range(3)]
        return let(F.coalesce(*starts, wanted - 3), lambda end: F.struct(
            F.when(~((offset < 0) | (offset > size) | inside(offset)), F.decode(F.substring(data, offset + 1, F.greatest(F.lit(0), end - offset)), "UTF-8")).alias("text"),
            size.alias("total"),
            F.when(~((offset < 0) | (offset > size) | inside(offset)) & (end < size), end).alias("next_cursor"),
        ))

    return let(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), of)


def pages_of_bytes(text: Column, limit: int) -> Column:
    """All pages of ``limit`` bytes, at least 4, each from where the one before ended."""
    most = F.ceil(F.octet_length(text) / (limit - 3)).cast("int")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pages"))

    def step(held: Column, _: Column) -> Column:
        page = page_of_bytes(text, held["at"], F.lit(limit))
        return F.when(held["at"].isNull(), held).otherwise(let(page, lambda p: F.struct(p["next_cursor"].alias("at"), F.concat(held["pages"], F.array(p["text"])).alias("pages"))))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), most)), start, step)["pages"]


# What badly decoded text begins with.
MOJIBAKE = ("þÿ", "ÿþ", "ï»¿", "ï¿½")


def quality(text: Column) -> Column:
    """Whether an extracted text is good enough to need no character recognition.

    At least 40 signal characters; at most 1 % control and 8 % private or replacement characters; no line of 8 and more
    characters is over 35 % of such lines (from 4 on); no token of 16 and more, 4 times repeated, is over 25 % of all
    token characters; no mark of bad decoding; no encoded run of 96 and more characters.
    """
    total = F.greatest(F.length(text), F.lit(1))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    signal = without(r"[\p{Z}\s\x{85}]")
    control = F.length(text) - without(r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}]")
    suspicious = F.length(text) - without(r"[\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}]")
    lines = F.filter(F.transform(F.split(text, r"\r?\n", -1), lambda x: F.trim(x)), lambda x: F.length(x) >= 8)
    tokens = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}+/_=\-]+"), F.lit(0))
    # Runs of equal values in a sorted array: the largest of number times weight.
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def largest(values: Column, least: int, weight) -> Column:
        def step(held: Column, x: Column) -> Column:
            n = F.when(x == held["last"], held["n"] + 1).otherwise(1)
            return F.struct(x.alias("last"), n.alias("n"), F.when(n >= least, F.greatest(held["most"], n * weight(x))).otherwise(held["most"]).alias("most"))

        return F.aggregate(F.array_sort(values), start, step)["most"]

    repeated_line = let(lines, lambda ls: F.when(F.size(ls) < 4, 0.0).otherwise(largest(ls, 1, lambda x: F.lit(1)) / F.size(ls)))
    sizes = lambda ts: F.greatest(F.aggregate(ts, F.lit(0), lambda n, t: n + F.length(t)), F.lit(1))
    repeated_token = let(tokens, lambda ts: largest(F.filter(ts, lambda t: F.length(t) >= 16), 4, F.length) / sizes(ts))
    return (
        (signal >= 40)
        & (control / total <= 0.01)
        & (suspicious / total <= 0.08)
        & (repeated_line <= 0.35)
        & (repeated_token <= 0.25)
        & ~text.rlike("|".join(MOJIBAKE))
        & ~F.exists(F.regexp_extract_all(text, F.lit(r"(?:^|[\p{Z}\s])([A-Za-z0-9+/_=\-]{96,})(?=[\p{Z}\s]|$)"), F.lit(1)), lambda t: entropy(t) >= 4.5)
    )


def entropy(token: Column) -> Column:
    """Bits per character of an ASCII token."""
    share = lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))) / F.length(token)
    letters = F.filter(F.array_distinct(F.split(token, "")), lambda c: c != "")
    return F.aggregate(letters, F.lit(0.0), lambda sum_, c: sum_ - share(c) * F.log2(share(c)))


def normalized_with_origins(source: str | None) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The text that ``normalize_text`` gives and runs (clean start, end, source start, end), all in UTF-8 bytes.

    A run covers characters that stand in the source as they are; a blank maps to all white space it stands for, and
    line ends between kept lines have no origin.
    """
    size = lambda s: len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass"))
    lines: list[tuple[str, bool, list[tuple[str, int, int]]]] = []  # clean text, whether blanks are left out, words
    at = 0
    for piece in _LINE_ENDS.split(source or ""):
        if not _LINE_ENDS.fullmatch(piece):
            words: list[tuple[str, int, int]] = []
            place, done = at, 0
            for m in _WORDS.finditer(piece):
                start = place + size(piece[done : m.start()])
                place, done = start + size(m[0]), m.end()
                words.append((m[0], start, place))
            line = " ".join(w for w, *_ in words)
            spaced = len(words) > 3 and _SPACED.fullmatch(line) is not None
            lines.append((line.replace(" ", "") if spaced else line, spaced, words))
        at += size(piece)
    counts = collections.Counter(t for t, *_ in lines if t and size(t) <= SHORT_LINE_BYTES)
    kept: list[tuple[str, bool, list[tuple[str, int, int]]]] = []
    for line in lines:
        low = line[0].translate({c: c + 32 for c in range(65, 91)}) if line[0][:1] in ("P", "p") else ""
        gone = counts[line[0]] > 1 or (low.startswith("page ") and " of " in low and re.search("[0-9]", low) is not None)
        if line[0] and not gone:
            kept.append(line)
        elif kept and kept[-1][0]:
            kept.append(("", False, []))
    while kept and not kept[-1][0]:
        kept.pop()
    runs, clean = [], 0
    for k, (_, spaced, words) in enumerate(kept):
        clean += k > 0  # the line end
        before = None
        for _, a, b in words:
            if before is not None and not spaced:
                if a - before == 1:  # a blank of one byte goes with its word
                    a = before
                else:
                    runs.append((clean, clean + 1, before, a))
                    clean += 1
            runs.append((clean, clean + b - a, a, b))
            clean, before = clean + b - a, b
    return "\n".join(t for t, *_ in kept), runs


#: Texts whose origins are held at once.
PIECE = 200
RUN = pa.struct([(n, pa.int32()) for n in ("clean_start", "clean_end", "source_start", "source_end")])


def origin_array(texts: pa.Array) -> pa.Array:
    """(clean, origins) of each text. Runs are four columns of whole numbers, never objects."""
    clean, ends, columns = [], [0], [array.array("i") for _ in range(4)]
    for t in texts:
        one, runs = normalized_with_origins(t.as_py())
        clean.append(one)
        ends.append(ends[-1] + len(runs))
        for column, numbers in zip(columns, zip(*runs, strict=True), strict=False):
            column.extend(numbers)
    runs = pa.StructArray.from_arrays([pa.Array.from_buffers(pa.int32(), len(c), [None, pa.py_buffer(c)]) for c in columns], fields=list(RUN))
    return pa.StructArray.from_arrays([pa.array(clean, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)], ["clean", "origins"])


def _origins(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in parts:
        for at in range(0, len(texts), PIECE):
            yield origin_array(texts.slice(at, PIECE))


def normalize_with_origins(text: Column | str) -> Column:
    """``normalize_text`` with the map back to the source. Needs a walk over words, so an Arrow function, by pieces of PIECE texts."""
    return F.arrow_udf(_origins, "struct<clean string, origins array<struct<clean_start int, clean_end int, source_start int, source_end int>>>")(text)


def source_span(origins: list[tuple[int, int, int, int]], start: int, end: int) -> tuple[int, int] | None:
    """The source bytes of clean bytes [start, end); None if none of them has an origin."""
    met = [(c, d, a, b) for c, d, a, b in origins if c < end and start < d]
    if start >= end or not met:
        return None
    exact = lambda c, d, a, b: d - c == b - a
    first, last = met[0], met[-1]
    low = first[2] + max(0, start - first[0]) if exact(*first) else first[2]
    high = last[3] - max(0, last[1] - end) if exact(*last) else last[3]
    return low, high

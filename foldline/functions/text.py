"""Column builders for text, with Python's notion of white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 29 code points that Python's ``str.strip`` and ``\\s`` take as white space.
WS = r"\x09-\x0D\x1C-\x20\x85\xA0  -     　"

#: The same code points as characters, by Python's own rule.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(c: Column) -> Column:
    """``c`` without white space at either end."""
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+\z", "")


def not_blank(c: Column) -> Column:
    return c.rlike(rf"[^{WS}]")


def terms(c: Column) -> Column:
    """Lower-case ASCII alphanumeric terms, extracted before lower-casing."""
    return F.transform(F.regexp_extract_all(c, F.lit("([a-zA-Z0-9]+)"), 1), F.lower)


def spaced(c: Column) -> Column:
    """``c`` with every white space as a plain space: patterns over it need a class of one character, which matches some ten times as fast."""
    return F.translate(c, WS_CHARS, " " * len(WS_CHARS))


def words(c: Column) -> Column:
    """The runs of characters that are no white space."""
    return F.regexp_extract_all(spaced(c), F.lit("[^ ]+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(spaced(c), F.lit("[^ ]+"))


#: Code points of a chunk.
CHUNK = 1024


def text_chunks(c: Column) -> Column:
    """``c`` in chunks of ``CHUNK`` code points, for ``part``: a place in a string is found by counting from its start, so many places need chunks."""
    return F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to before ``end`` of a text in chunks, at the cost of their number."""
    first = F.floor(start / CHUNK).cast("int")
    held = F.array_join(F.slice(chunks, first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(held, (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))).otherwise("")

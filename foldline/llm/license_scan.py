"""Licences that a text names: notice phrases and identifier tags, found by one Aho-Corasick automaton over its words.

A text becomes its words, joined by single spaces; the automaton of all phrases, each between spaces, reports every place of every phrase in one
pass, whatever their number. Where it meets an identifier tag, the licence expression behind the tag is read from the text
by a shunting-yard parser (with before and before or) and evaluated: ``or`` leaves the less restrictive choice, ``and`` binds to both sides, an exception given by ``with`` softens
what it is attached to. A text is one row throughout; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm._packs import as_bytes
from foldline.llm._shared import small_batches

# Fixed values of the contract: phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further phrases of notices and licence texts.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "permission to use copy modify and or distribute this software": "isc",
    "free and unencumbered software released into the public domain": "unlicense",
    "boost software license": "bsl",
    "cc by 4 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0",
}
#: Words of the tags whose line goes on with an expression.
TAGS = ("spdx license identifier", "license expression")
#: How much a licence restricts reuse, by family; ids of any version fall into their family.
RESTRICTION = {
    0.1: ("0bsd", "apache", "bsd", "bsl", "cc-by", "cc0", "isc", "mit", "python", "unlicense", "zlib"),
    0.4: ("cc-by-sa", "cddl", "epl", "lgpl", "mpl"),
    0.7: ("agpl", "gfdl", "gpl", "osl"),
    1.0: ("cc-by-nc", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd"),
}
UNKNOWN = 0.9
_FAMILY = {name: value for value, names in RESTRICTION.items() for name in names}
_RANK = {"or": 1, "and": 2, "with": 3}
_TAG = re.compile(rb"(?:spdx-license-identifier|license-expression)[\x22']?[\x20\t]*[:=][\x20\t]*[\x22']?", re.IGNORECASE)
_TOKEN = re.compile(rb"[\x20\t]*([()]|[A-Za-z0-9](?:[A-Za-z0-9.:+-]*[A-Za-z0-9+])?)")
_SPACED = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_KEEP = "base", "notice", "tag"


def family(label: str) -> str:
    """The family of an identifier: without version and without only or or-later."""
    return re.sub(r"(-[0-9][0-9.]*)?(-only|-or-later|\+|-clause)*$", "", label)


def label_of(identifier: str) -> str:
    """An identifier in lower case without a trailing .0 and without only or or-later; Creative Commons ones without version."""
    name = re.sub(r"(-only|-or-later|\+)+$", "", identifier.lower())
    return family(name) if name.startswith("cc") else re.sub(r"\.0$", "", name)


def restriction(label: str) -> float:
    return _FAMILY.get(label, _FAMILY.get(family(label), UNKNOWN))


def postfix(tokens: list[str]) -> list[str] | None:
    """The expression that ``tokens`` begin with, operands before operators; None where it is incomplete. It ends where an operand cannot stand."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for t in tokens:
        name = t.lower()
        if name in _RANK:
            if operand:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[name]:
                out.append(held.pop())
            held.append(name)
            operand = True
        elif t == ")":
            if operand:
                return None
            if "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif not operand:
            break
        elif t == "(":
            held.append(t)
        else:
            out.append(t)
            operand = False
    return None if operand or "(" in held else out + held[::-1]


def evaluated(expression: list[str]) -> tuple[float, list[str]]:
    """(restriction, labels that bind) of an expression in postfix form."""
    stack: list[tuple[float, list[str]]] = []
    for t in expression:
        if t not in _RANK:
            stack.append((restriction(label_of(t)), [label_of(t)]))
            continue
        right, left = stack.pop(), stack.pop()
        if t == "or":
            stack.append(min(left, right, key=lambda x: x[0]))
        elif t == "and":
            stack.append((max(left[0], right[0]), left[1] + right[1]))
        else:
            stack.append((left[0] / 2 if left[0] > 0.1 else left[0], left[1]))
    return stack[0]


def tagged(text: bytes) -> list[dict]:
    """The expressions behind the tags of a text: words, labels of all identifiers, those that bind, and restriction (null where the expression is incomplete)."""
    out = []
    for tag in _TAG.finditer(text):
        tokens, at = [], tag.end()
        while m := _TOKEN.match(text, at):
            tokens.append(m[1].decode())
            at = m.end()
        if not tokens:
            continue
        rpn = postfix(tokens)
        if rpn is None:
            out.append({"expression": None, "labels": [], "binding": [], "restriction": None})
            continue
        value, binding = evaluated(rpn)
        exceptions = {rpn[i - 1] for i, t in enumerate(rpn) if t == "with"}
        names = sorted({label_of(t) for t in rpn if t not in _RANK and t not in exceptions})
        out.append({"expression": " ".join(rpn), "labels": names, "binding": sorted(set(binding)), "restriction": value})
    return out


@lru_cache(maxsize=4)
def _automaton(base: tuple, notices: tuple, tags: tuple) -> ahocorasick.Automaton:
    found: dict[str, list] = {}
    for kind, phrases in zip(_KEEP, (base, notices, [(t, t) for t in tags]), strict=True):
        for phrase, label in phrases:
            found.setdefault(f" {phrase} ", []).append((kind, label, len(phrase) + 1))
    out = ahocorasick.Automaton()
    for phrase, what in found.items():
        out.add_word(phrase, tuple(what))
    out.make_automaton()
    return out


def scanned(text: bytes, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[str, str, int]]]:
    """(number of words, places as (kind, label, first word)) of a text; bytes of characters beyond ASCII belong to words."""
    words = text.translate(_SPACED).split()
    joined = " " + b" ".join(words).decode("latin-1") + " "
    hits = [(end - back, kind, label) for end, what in automaton.iter(joined) for kind, label, back in what]
    if not hits:
        return len(words), []
    before = np.cumsum(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
    return len(words), [(kind, label, int(before[at]) - 1) for at, kind, label in hits]


_OUT = "n_words long, places array<struct<kind: string, label: string, word: long>>, expressions array<struct<expression: string, labels: array<string>, binding: array<string>, restriction: double>>"
_PLACES = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64())]))
_EXPRESSIONS = pa.list_(pa.struct([("expression", pa.string()), ("labels", pa.list_(pa.string())), ("binding", pa.list_(pa.string())), ("restriction", pa.float64())]))


def license_scan(docs: DataFrame, *, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, expressions) of each row's whole text.

    Words are what ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` finds after A-Z become lower case. ``places`` has every place of every phrase, overlapping ones too: kind (base, notice or tag), label and
    the number of its first word, from 0. ``expressions`` are those behind tags, in their order; one that is incomplete has null
    for expression and restriction. Null and empty texts have no words and no places. Ids may be null or repeat: each row is judged for itself. A very long text costs its bytes. An empty table gives no rows.
    Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    phrases = tuple(base.items()), tuple(notices.items()), tuple(tags)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(*phrases)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            found = [scanned(t, automaton) for t in texts]
            places = [[{"kind": k, "label": x, "word": w} for k, x, w in p] for _, p in found]
            tagged_ = [tagged(t) if any(k == "tag" for k, _, _ in p) else [] for t, (_, p) in zip(texts, found, strict=True)]
            data = [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(places, _PLACES), pa.array(tagged_, _EXPRESSIONS)]
            yield pa.RecordBatch.from_arrays(data, names=["doc_id", "n_words", "places", "expressions"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, f"doc_id long, {_OUT}")


def judged(found: DataFrame) -> DataFrame:
    """``found`` with labels (sorted, of notices and expressions) and score: the greatest restriction of any notice or expression, 0 without any; an incomplete expression counts as unknown."""
    stated = F.filter("places", lambda p: p["kind"] != "tag")
    names = F.array_union(F.transform(stated, lambda p: p["label"]), F.flatten(F.transform("expressions", lambda e: e["labels"])))
    degree = F.lit(UNKNOWN)
    known = sorted({*BASE.values(), *NOTICES.values()})
    table = F.create_map(*[F.lit(x) for name in known for x in (name, restriction(name))])
    of_notice = F.transform(stated, lambda p: F.coalesce(F.element_at(table, p["label"]), degree))
    of_tag = F.transform("expressions", lambda e: F.coalesce(e["restriction"], degree))
    return found.withColumn("labels", F.array_sort(F.array_distinct(names))).withColumn("score", F.coalesce(F.array_max(F.concat(of_notice, of_tag)), F.lit(0.0)))

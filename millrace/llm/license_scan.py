"""Licence scans: an Aho-Corasick automaton finds notices and identifier tags; a shunting-yard parser evaluates
licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


from millrace.llm.common import slices

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Further phrases of notices and standard headers, in plain words, and their labels.
NOTICES = (
    ("mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("apache license", "apache"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("gnu general public license", "gpl"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu general public license as published by the free software foundation either version 2", "gpl-2.0-or-later"),
    ("gnu general public license as published by the free software foundation either version 3", "gpl-3.0-or-later"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu library general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("mozilla public license v 2 0", "mpl-2.0"),
    ("eclipse public license", "epl"),
    ("common development and distribution license", "cddl"),
    ("european union public licence", "eupl"),
    ("boost software license", "bsl-1.0"),
    ("bsd license", "bsd"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd-3-clause"),
    ("isc license", "isc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("zlib license", "zlib"),
    ("do what the fuck you want to public license", "wtfpl"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution share alike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons zero", "cc0-1.0"),
    ("all rights reserved", "proprietary"),
)
TAG = "spdx license identifier"
#: Identifiers that may stand in an expression: those that permit use without reciprocal terms, and the others. An
#: identifier before | has the versions after it.
PERMISSIVE_IDS = """
0bsd afl-3.0 apache|1.0,1.1,2.0 artistic-2.0 blueoak-1.0.0 bsd|1-clause,2-clause,2-clause-patent,3-clause,3-clause-clear,4-clause bsl-1.0 bzip2-1.0.6 cc0-1.0
cc-by|1.0,2.0,2.5,3.0,4.0 curl ecl-2.0 fsfap ftl hpnd icu ijg isc json libpng libpng-2.0 mit mit-0 mit-cmu mit-feh ms-pl mulanpsl-2.0 ncsa ntp openssl php-3.01
postgresql psf-2.0 python-2.0 ruby tcl unicode-dfs-2016 unicode-3.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
"""
OTHER_IDS = """
agpl|1.0,3.0,3.0-only,3.0-or-later artistic-1.0 busl-1.1 cc-by-nc|1.0,2.0,2.5,3.0,4.0 cc-by-nc-nd|1.0,2.0,2.5,3.0,4.0 cc-by-nc-sa|1.0,2.0,2.5,3.0,4.0
cc-by-nd|1.0,2.0,2.5,3.0,4.0 cc-by-sa|1.0,2.0,2.5,3.0,4.0 cddl|1.0,1.1 cecill|1.0,2.0,2.1 cpal-1.0 cpl-1.0 elastic-2.0 epl|1.0,2.0 eupl|1.0,1.1,1.2 gfdl|1.1,1.2,1.3
gpl|1.0,1.0-only,1.0-or-later,2.0,2.0-only,2.0-or-later,3.0,3.0-only,3.0-or-later ipl-1.0 lgpl|2.0,2.0-only,2.0-or-later,2.1,2.1-only,2.1-or-later,3.0,3.0-only,3.0-or-later
lppl-1.3c mpl|1.0,1.1,2.0 ms-rl npl-1.1 odbl-1.0 ofl-1.1 osl|1.0,2.0,2.1,3.0 qpl-1.0 sissl sspl-1.0
"""


def _identifiers(listed: str) -> frozenset[str]:
    parts = (x.partition("|") for x in listed.split())
    return frozenset(f"{name}-{v}" if v else name for name, _, versions in parts for v in versions.split(","))


PERMISSIVE = _identifiers(PERMISSIVE_IDS)
KNOWN = PERMISSIVE | _identifiers(OTHER_IDS)
#: Names of one's own, as expressions allow them.
_OWN = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
#: What follows a tag's words up to the end of the line.
_LINE = re.compile(rb"[ \t]*:[ \t]*([^\r\n]*)")


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: an expression of identifiers, and, or, with and parentheses in postfix order; None if none stands at the
    beginning.

    What cannot go on the expression ends it (a comment's end, say); then an operator without a right side is dropped and open
    parentheses are closed.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether the last token ends an operand
    for found in _TOKEN.finditer(expression):
        token = found[0]
        low = token.lower()
        if low in _RANK:
            if not operand:
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
        elif token == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break
            out.append(low)
            operand = True
    while not operand and stack:  # what waits for a right side
        operand = stack.pop() != "("
    return out + [x for x in stack[::-1] if x != "("] if out else None


def evaluate(postfix: Sequence[str]) -> tuple[set[str], bool] | None:
    """The identifiers of an expression, and whether it can be met by permissive licences alone (or: either side can). Words that
    are no identifiers are left out and not permissive; None without any identifier, or if the order is broken."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in _RANK:
            if len(stack) < 2:
                return None
            (b, free_b), (a, free_a) = stack.pop(), stack.pop()
            if token == "with":  # the exception belongs to its licence
                stack.append(({f"{x} with {y}" for x in a for y in b}, free_a))
            else:
                small, large = sorted((a, b), key=len)
                large |= small  # in place: a long expression would copy its set for each operator
                stack.append((large, (free_a or free_b) if token == "or" else (free_a and free_b)))
        else:
            plain = token.removesuffix("+")
            named = plain in KNOWN or _OWN.fullmatch(token) or "exception" in token
            stack.append(({token} if named else set(), plain in PERMISSIVE))
    return stack[0] if len(stack) == 1 and stack[0][0] else None


def build_automaton() -> ahocorasick.Automaton:
    """Phrases as words between single spaces; an entry is its length and a list of (label, whether it is a base one), the tag's is empty."""
    entries: dict[str, list[tuple[str, bool]]] = {TAG: []}
    for phrases, base in ((BASE, True), (NOTICES, False)):
        for phrase, label in phrases:
            entries.setdefault(phrase, []).append((label, base))
    automaton = ahocorasick.Automaton()
    for phrase, found in entries.items():
        automaton.add_word(f" {phrase} ", (len(phrase) + 2, found))
    automaton.make_automaton()
    return automaton


_AUTOMATON: list[ahocorasick.Automaton] = []


def _tagged(raw: bytes, flat: bytes, tags: list[int]) -> Iterator[tuple[int, str]]:
    """For the tags (their first words) that a colon follows: the first word, and the text up to the end of the line or the next tag."""
    first, last = set(tags), {w + 2 for w in tags}
    starts, ends = [], []
    for k, m in enumerate(_WORD.finditer(flat)):
        if k in first:
            starts.append(m.start())
        if k in last:
            ends.append(m.end())
    for word, end, stop in zip(tags, ends, [*starts[1:], len(raw)], strict=True):
        line = _LINE.match(raw, end, stop)
        if line:
            yield word, line[1].decode("utf-8", "replace")


def scan_text(text: str) -> tuple[int, list[tuple[int, str, bool]], bool | None, float]:
    """Number of words; places (word, label, base); whether its expressions are permissive; score."""
    if not _AUTOMATON:
        _AUTOMATON.append(build_automaton())
    raw = text.encode()
    flat = raw.translate(_WORDS)
    words = flat.split()
    hay = f" {b' '.join(words).decode()} "
    places: list[tuple[int, str, bool]] = []
    hits = sorted(((end - length + 1, found) for end, (length, found) in _AUTOMATON[0].iter(hay)), key=lambda h: h[0])
    tags: list[int] = []
    seen = at = 0
    for start, found in hits:
        seen += hay.count(" ", at, start + 1)
        at = start + 1
        places += [(seen - 1, label, base) for label, base in found]
        if not found:
            tags.append(seen - 1)
    evidence, free = len({w for w, _, _ in places}), None
    for word, expression in _tagged(raw, flat, tags) if tags else ():
        postfix = to_postfix(expression)
        value = evaluate(postfix) if postfix else None
        if value:
            places += [(word, x, False) for x in sorted(value[0])]
            free = value[1] if free is None else free and value[1]
            evidence += 1
    return len(words), places, free, evidence / (evidence + 1)


_PLACE = T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType())])


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Find licence notices and tags in every whole text: id, n_words, places, permissive, score.

    places: (word, label, base) of each phrase (base: of the base phrases) and identifier; words count from 0. permissive:
    whether all tagged expressions can be met by permissive licences, null without one. score: n / (n + 1) for n places with
    evidence (a phrase, or a tag with identifiers); all count alike. An expression's words that are no known identifiers give no labels.
    Null counts as empty. Texts of any length and lines of any length are read whole. One pass without a shuffle; equal rows give equal rows; an empty table gives an empty result; other columns are not read.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(_PLACE)), T.StructField("permissive", T.BooleanType()), T.StructField("score", T.DoubleType())])
    kinds = (pa.int64(), pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())])), pa.bool_(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for start, end in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                rows = [scan_text(t or "") for t in texts.slice(start, end - start).to_pylist()]
                columns = [[r[0] for r in rows], [[{"word": w, "label": x, "base": b} for w, x, b in r[1]] for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_words", "places", "permissive", "score"])

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id)


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    base = F.filter("places", lambda p: p["base"])

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(places["label"])), ",")

    return found.select(
        id, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base["word"]).alias("first_word"), F.array_max(base["word"]).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), "score", "permissive",
    )

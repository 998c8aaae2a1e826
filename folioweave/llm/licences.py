"""License scans: Aho-Corasick matching and shunting-yard evaluation.

One automaton holds identifier tags (``SPDX-License-Identifier:`` and the like),
another the notice phrases. What follows a tag on its line is a licence
expression: a shunting-yard parser turns it into postfix form, in which WITH
binds closest, then AND, then OR, for which a slash may stand. The value of an
expression is allow, unknown or deny; AND takes the worse side, OR the better,
and an exception WITH one of the licences that it belongs to is allowed. After
the plain tag ``License:``, where prose may follow, an expression counts only if
it names a known licence. A notice phrase stands for its licence. All findings of
a document hold together, so its verdict is the worst of them.

Plan: one Arrow pass over (doc_id, text), no shuffle.

Defined results: letter case and, in notices, the kind of white space do not
matter; a match must stand between non-alphanumeric characters; overlapping
notices yield to the leftmost, then longest; an expression that does not parse
is kept as found with the value unknown; a document without findings, or with a
null or empty text, has empty arrays and the verdict none; very long texts are
scanned whole; rows come out as often as they went in, in particular repeated rows
and null ids; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_runs

ALLOW, UNKNOWN, DENY = 2, 1, 0
VERDICTS = {ALLOW: "allow", UNKNOWN: "unknown", DENY: "deny"}

PLAIN_TAG = "license:"
TAGS = ("spdx-license-identifier:", "license-identifier:", "license-expression:", PLAIN_TAG)

#: Identifiers, in lower case, and whether training on the text is allowed.
POLICY = {
    **dict.fromkeys(
        ["mit", "mit-0", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "0bsd", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "cc-by-3.0",
         "bsl-1.0", "python-2.0", "psf-2.0", "ncsa", "postgresql", "x11", "wtfpl", "artistic-2.0", "odc-by-1.0", "pddl-1.0", "blueoak-1.0.0"],
        ALLOW,
    ),
    **dict.fromkeys(["mpl-2.0", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-2.1", "lgpl-3.0-only", "lgpl-3.0-or-later", "lgpl-3.0", "epl-2.0", "epl-1.0", "cddl-1.0", "cc-by-sa-4.0", "odbl-1.0"], UNKNOWN),
    **dict.fromkeys(
        ["gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later",
         "cc-by-nc-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0", "cc-by-nd-4.0", "sspl-1.0", "busl-1.1", "licenseref-proprietary"],
        DENY,
    ),
}
_GPL2 = ("gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-2.0+")
_GPL3 = ("gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "gpl-3.0+")
#: Exceptions and the licences with which they are allowed.
EXCEPTIONS = {
    "classpath-exception-2.0": frozenset(_GPL2 + _GPL3),
    "gcc-exception-3.1": frozenset(_GPL3),
    "llvm-exception": frozenset(["apache-2.0"]),
    "linux-syscall-note": frozenset(_GPL2),
    "font-exception-2.0": frozenset(_GPL2 + _GPL3),
    "bison-exception-2.2": frozenset(_GPL2 + _GPL3),
    "autoconf-exception-3.0": frozenset(_GPL3),
}

NOTICES = {
    "licensed under the apache license, version 2.0": "apache-2.0",
    "apache license, version 2.0": "apache-2.0",
    "apache license 2.0": "apache-2.0",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "mit license": "mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "licensed under the gnu general public license, version 3": "gpl-3.0-only",
    "gnu general public license, version 3": "gpl-3.0-only",
    "gnu general public license, version 2": "gpl-2.0-only",
    "gnu general public license": "gpl-3.0",
    "gnu lesser general public license": "lgpl-3.0",
    "gnu affero general public license": "agpl-3.0",
    "mozilla public license, version 2.0": "mpl-2.0",
    "redistribution and use in source and binary forms, with or without modification": "bsd-3-clause",
    "licensed under cc by-nc 4.0": "cc-by-nc-4.0",
    "cc by-nc-sa 4.0": "cc-by-nc-sa-4.0",
    "cc by-nc-nd 4.0": "cc-by-nc-nd-4.0",
    "cc by-nc 4.0": "cc-by-nc-4.0",
    "cc by-nd 4.0": "cc-by-nd-4.0",
    "cc by-sa 4.0": "cc-by-sa-4.0",
    "cc by 4.0": "cc-by-4.0",
    "creative commons attribution 4.0": "cc-by-4.0",
    "creative commons attribution-noncommercial 4.0": "cc-by-nc-4.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license": "bsl-1.0",
    "eclipse public license": "epl-2.0",
    "all rights reserved": "licenseref-proprietary",
}

_TOKEN = re.compile(r"\(|\)|/|[a-z0-9][a-z0-9.+:-]*", re.ASCII)
_BINDS = {"or": 1, "and": 2, "with": 3}


def tokens(expression: str) -> list[str]:
    """The tokens at the start of a line that can belong to an expression, comment marks left off."""
    out, depth, operand = [], 0, True
    at = 0
    while m := _TOKEN.match(expression, at + len(expression[at:]) - len(expression[at:].lstrip(" \t"))):
        t = "or" if m.group() == "/" else m.group().rstrip(".:") or m.group()
        if operand:
            if t == "(":
                depth += 1
            elif t == ")" or t in _BINDS:
                break
            else:
                operand = False
        elif t in _BINDS:
            operand = True
        elif t == ")" and depth:
            depth -= 1
        else:
            break
        out.append(t)
        at = m.end()
    return out


def postfix(found: list[str]) -> list[str] | None:
    """Shunting-yard; null where operands, operators and brackets do not make an expression."""
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for t in found:
        if operand and t == "(":
            stack.append(t)
        elif operand and t != ")" and t not in _BINDS:
            out.append(t)
            operand = False
        elif not operand and t in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif not operand and t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            return None
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def value_of(identifier: str) -> int:
    return POLICY.get(identifier, POLICY.get(identifier.rstrip("+"), UNKNOWN))


def is_known(identifier: str) -> bool:
    return identifier.rstrip("+") in POLICY


def evaluate(form: list[str]) -> int:
    """The value of a postfix expression."""
    values: list[tuple[int, str]] = []
    for t in form:
        if t not in _BINDS:
            values.append((value_of(t), t))
            continue
        (right, name), (left, licence) = values.pop(), values.pop()
        if t == "with":
            values.append((ALLOW if licence in EXCEPTIONS.get(name, ()) else min(left, UNKNOWN), ""))
        else:
            values.append((min(left, right) if t == "and" else max(left, right), ""))
    return values[0][0]


@cache
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return a


def matches(text: str, words: tuple[str, ...]) -> list[tuple[int, str]]:
    """(start, word) of the words in the text: bounded, leftmost, then longest, without overlap."""
    found = []
    for end, word in _automaton(words).iter(text):
        start = end + 1 - len(word)
        if (start == 0 or not text[start - 1].isalnum() or not word[0].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum() or not word[-1].isalnum()):
            found.append((start, -len(word), word))
    out, free = [], 0
    for start, _, word in sorted(found):
        if start >= free:
            out.append((start, word))
            free = start + len(word)
    return out


def scan(text: str | None) -> tuple[list[str], list[str], str]:
    """(expressions after tags, licences of notices, verdict)."""
    if not text:
        return [], [], "none"
    lower = text.lower()
    expressions, values = [], []
    for start, tag in matches(lower, TAGS):
        end = lower.find("\n", start)
        parsed = tokens(lower[start + len(tag) : len(lower) if end < 0 else end])
        if not parsed or (tag == PLAIN_TAG and not any(map(is_known, parsed))):
            continue
        form = postfix(parsed)
        expressions.append(" ".join(parsed))
        values.append(UNKNOWN if form is None else evaluate(form))
    notices = sorted({NOTICES[w] for _, w in matches(" ".join(lower.split()), tuple(NOTICES))})
    values += [POLICY[x] for x in notices]
    return expressions, notices, VERDICTS[min(values)] if values else "none"


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, expressions, licences, verdict) for every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches):
            expressions, licences, verdicts = zip(*map(scan, batch.column(1).to_pylist()))
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(expressions, strings), pa.array(licences, strings), pa.array(verdicts, pa.string())],
                ["doc_id", "expressions", "licences", "verdict"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expressions array<string>, licences array<string>, verdict string")

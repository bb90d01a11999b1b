"""License scans: Aho-Corasick finds identifier tags and notice phrases; a shunting-yard parser reads the expressions.

A text is brought to words (A-Z lower-cased, runs of digits, a-z and non-ASCII characters) with one space between, so a
phrase is found whatever separates its words. Each tag's expression is parsed from the text as it stands, with ``with``
binding before ``and``, and that before ``or``; it is evaluated against a list of permissive licences.

Defined results. Null or empty text: no words, no labels, score 0. A tag without a readable expression: label ``spdx``.
Repeated rows: each its result. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import slices, table

#: Fixed values of the task: phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method's own.
NOTICES = {
    "academic free license": "afl",
    "affero general public license": "agpl",
    "apache license": "apache",
    "apache software license": "apache",
    "artistic license": "artistic",
    "boost software license": "bsl-1.0",
    "bsd license": "bsd",
    "business source license": "busl",
    "common development and distribution license": "cddl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "free documentation license": "gfdl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "microsoft public license": "ms-pl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "no rights reserved": "public-domain",
    "open database license": "odbl",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "postgresql license": "postgresql",
    "public domain": "public-domain",
    "python software foundation license": "psf",
    "redistribution and use in source and binary forms": "bsd",
    "released under the unlicense": "unlicense",
    "server side public license": "sspl",
    "sil open font license": "ofl",
    "this is free and unencumbered software": "unlicense",
    "universal permissive license": "upl",
    "zlib license": "zlib",
}
TAG = "spdx license identifier"
#: Licences that an expression is evaluated against.
PERMISSIVE = frozenset({"0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc-by-4.0", "cc0-1.0", "isc", "mit", "unlicense", "zlib"})
#: How much each kind of evidence tells; independent ones add up as 1 - product(1 - weight).
WEIGHTS = {"tag": 0.9, "notice": 0.6, "base": 0.5}

_TAG = re.compile(r"spdx-license-identifier\s*:", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*)", re.ASCII)
_RANK = {"or": 1, "and": 2, "with": 3}
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _tokens(text: str, at: int) -> Iterator[str]:
    """Tokens that can stand next to each other in an expression: it ends where two operands meet, or at another sign."""
    depth, operand = 0, True  # operand: one is awaited
    while m := _TOKEN.match(text, at):
        token = m[1] if m[1] in "()" else m[1].lower().rstrip(".")
        if token == "(" and operand:
            depth += 1
        elif token == ")" and not operand and depth:
            depth -= 1
        elif token in _RANK and not operand:
            operand = True
        elif token not in _RANK and token not in "()" and operand:
            operand = False
        else:
            return
        yield token
        at = m.end()


def parse(tokens: Iterable[str]) -> list[str]:
    """Shunting yard: the expression in reverse Polish order. Open brackets and operators without a right operand are
    closed where the expression breaks off."""
    out, stack, last = [], [], ""
    for token in tokens:
        if token in _RANK:
            while stack and stack[-1] in _RANK and _RANK[stack[-1]] >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
        elif token == "(":
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if stack:
                stack.pop()
        else:
            out.append(token)
        last = token
    if last in _RANK:
        stack.pop()
    return out + [x for x in reversed(stack) if x != "("]


def evaluate(rpn: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[bool, list[str]]:
    """Whether a choice of the expression is allowed, and its licences. An exception (``with``) only widens a licence."""
    stack: list[tuple[bool, list[str]]] = []
    for token in rpn:
        if token in _RANK and len(stack) > 1:
            (b, right), (a, left) = stack.pop(), stack.pop()
            stack.append((a or b, left + right) if token == "or" else (a and b, left + right) if token == "and" else (a, left))
        elif token not in _RANK:
            stack.append((token in allowed, [token]))
    return (all(a for a, _ in stack), [x for _, names in stack for x in names]) if stack else (False, [])


class Scanner:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for phrase, label, kind in [*((p, x, "base") for p, x in BASE.items()), *((p, x, "notice") for p, x in NOTICES.items()), (TAG, "", "tag")]:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, label, kind))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive."""
        words = text.encode("utf-8", "replace").translate(_BYTES).split()
        plain = b" " + b" ".join(words) + b" " if words else b""
        hits = list(self.automaton.iter(plain.decode("latin-1")))
        if not hits:
            return len(words), 0, None, None, "", "", 0.0, "", None
        spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
        kinds = [kind for _, (_, _, kind) in hits]
        base = np.searchsorted(spaces, [end - size + 1 for end, (size, _, kind) in hits if kind == "base"])
        base_labels = {label for _, (_, label, kind) in hits if kind == "base"}
        labels = {label for _, (_, label, _) in hits if label}
        expressions, permissive = [], None
        if "tag" in kinds:
            for m in _TAG.finditer(text):
                rpn = parse(_tokens(text, m.end()))
                ok, names = evaluate(rpn)
                permissive = ok if permissive is None else permissive and ok
                expressions.append(" ".join(rpn))
                labels.update(names or ["spdx"])
            if not expressions:  # the words of a tag without its signs
                labels.add("spdx")
        score = 1.0 - float(np.prod([1 - WEIGHTS[kind] for kind in sorted(set(kinds))]))
        n = len(base)
        return len(words), n, int(base.min()) if n else None, int(base.max()) if n else None, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, ";".join(expressions), permissive


def license_scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and the scan of every whole text (see ``Scanner.scan``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for part in slices(batches, "text"):
            rows = [scanner.scan(x or "") for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [key, *names])

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_()]
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expressions string, permissive boolean")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op5_licenses": op5_licenses}
ORACLES: dict[str, str] = {}

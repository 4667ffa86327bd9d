"""License scan: an Aho-Corasick automaton over notice phrases and identifier tags, and licence expressions.

Words are runs of 0-9, a-z (A-Z lower-cased) and everything beyond ASCII. The text becomes one line of words with single
spaces; one automaton pass over it finds every phrase as a sequence of whole words. Where the line holds an identifier tag,
the expression behind each tag of the raw text is read: a shunting-yard parser turns ``and``/``or``/``with`` and brackets
into postfix order, which is evaluated to the licence families named and to a permissiveness between 0 and 1 (``or`` takes
the freer side, ``and`` the stricter one, ``with`` loosens its licence).

Defined results: a null text counts as empty (no words, no labels, score 0). Each input row gives one output row, repeated
rows and null ids included. An expression counts up to its last complete part; identifiers of no known family add no label.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import map_blocks

#: The base phrases of the contract and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases (words as the scan sees them), their labels and the weight of the evidence.
NOTICE_PHRASES = {
    "gnu lesser general public license": ("lgpl", 0.7),
    "gnu library general public license": ("lgpl", 0.7),
    "gnu affero general public license": ("agpl", 0.7),
    "mozilla public license": ("mpl", 0.7),
    "eclipse public license": ("epl", 0.7),
    "european union public licence": ("eupl", 0.7),
    "boost software license": ("bsl", 0.7),
    "isc license": ("isc", 0.7),
    "zlib license": ("zlib", 0.7),
    "bsd license": ("bsd", 0.7),
    "bsd 2 clause": ("bsd", 0.7),
    "bsd 3 clause": ("bsd", 0.7),
    "creative commons attribution": ("cc-by", 0.7),
    "creative commons zero": ("cc0", 0.7),
    "cc0 1 0 universal": ("cc0", 0.9),
    "expat license": ("mit", 0.7),
    "licensed under the apache license version 2 0": ("apache", 0.9),
    "under the terms of the gnu general public license": ("gpl", 0.9),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "redistribution and use in source and binary forms with or without modification": ("bsd", 0.9),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.9),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "this source code form is subject to the terms of the mozilla public license": ("mpl", 0.9),
}
BASE_WEIGHT, EXPRESSION_WEIGHT = 0.6, 0.95
#: Tags as words; any of them makes the raw text worth a search for expressions.
TAG_WORDS = ("spdx license identifier", "license expression", "licence expression")
TAG = re.compile(r"(?ai:spdx-license-identifier|licen[sc]e-expression)[\t ]*[:=][\t ]*[\"']?([^\r\n\"']*)")
#: Families by the start of an identifier, longest start first, and how permissive each is.
FAMILIES = {
    "agpl": ("agpl", 0.1),
    "gpl": ("gpl", 0.2),
    "lgpl": ("lgpl", 0.4),
    "mpl": ("mpl", 0.5),
    "epl": ("epl", 0.5),
    "eupl": ("eupl", 0.4),
    "cc-by-nc": ("cc-by-nc", 0.1),
    "cc-by-nd": ("cc-by-nd", 0.1),
    "cc-by-sa": ("cc-by-sa", 0.4),
    "cc-by": ("cc-by", 0.8),
    "cc0": ("cc0", 1.0),
    "unlicense": ("unlicense", 1.0),
    "0bsd": ("bsd", 1.0),
    "bsd": ("bsd", 0.9),
    "mit": ("mit", 0.9),
    "apache": ("apache", 0.9),
    "isc": ("isc", 0.9),
    "zlib": ("zlib", 0.9),
    "bsl": ("bsl", 0.9),
}
_OPERATORS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[\t ]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_LOWER = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
FIELDS = {
    "doc_id": "long",
    "n_words": "long",
    "n_base": "long",
    "first_word": "long",
    "last_word": "long",
    "base_labels": "string",
    "labels": "string",
    "score": "double",
    "expressions": "string",
    "permissive": "double",
}


def family(identifier: str) -> tuple[str | None, float]:
    """Family and permissiveness of one identifier; unknown ones are taken as strict."""
    name = identifier.lower()
    for start in sorted(FAMILIES, key=len, reverse=True):
        if name == start or name.startswith((start + "-", start + "+")):
            return FAMILIES[start]
    return None, 0.0


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands and operators in postfix order; raises ValueError if brackets or operators are off."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in tokens:
        word = token.lower()
        if word == "(":
            if not operand_next:
                raise ValueError("bracket after an operand")
            stack.append(word)
        elif word == ")":
            if operand_next:
                raise ValueError("bracket without operand")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("bracket was not opened")
            stack.pop()
        elif word in _OPERATORS:
            if operand_next:
                raise ValueError("operator without operand")
            while stack and stack[-1] != "(" and _OPERATORS[stack[-1]] >= _OPERATORS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError("two operands in a row")
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        raise ValueError("unfinished expression")
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Families named and permissiveness. What follows ``with`` is an exception, not a licence."""
    values: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in _OPERATORS:
            name, free = family(token)
            values.append(({name} if name else set(), free))
            continue
        right, left = values.pop(), values.pop()
        if token == "with":
            values.append((left[0], left[1] + 0.5 * (1 - left[1])))
        else:
            values.append((left[0] | right[0], (max if token == "or" else min)(left[1], right[1])))
    return values[0]


def complete(tokens: list[str]) -> int:
    """Tokens of the longest prefix that is an expression. What breaks a prefix breaks every longer one, so one pass tells."""
    open_brackets, operand_next, last = 0, True, 0
    for place, token in enumerate(tokens, 1):
        word = token.lower()
        if word == "(":
            if not operand_next:
                break
            open_brackets += 1
        elif word == ")":
            if operand_next or not open_brackets:
                break
            open_brackets -= 1
        elif operand_next == (word in _OPERATORS):
            break
        else:
            operand_next = word in _OPERATORS
        if not operand_next and not open_brackets:
            last = place
    return last


def parse_expression(text: str) -> tuple[str, set[str], float] | None:
    """Canonical postfix form, families and permissiveness of the longest prefix of ``text`` that is an expression."""
    tokens: list[str] = []
    at = 0
    while found := _TOKEN.match(text, at):
        tokens.append(found[1])
        at = found.end()
        if len(tokens) >= 2 and not {tokens[-1].lower(), tokens[-2].lower()} & {*_OPERATORS, "(", ")"}:
            tokens.pop()  # prose goes on behind the expression
            break
    tokens = tokens[: complete(tokens)]
    if not tokens:
        return None
    postfix = to_postfix(tokens)
    return (" ".join(postfix), *evaluate(postfix))


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for phrase, label in BASE_PHRASES.items():
        entries.setdefault(phrase, []).append(("base", label, BASE_WEIGHT, len(phrase)))
    for phrase, (label, weight) in NOTICE_PHRASES.items():
        entries.setdefault(phrase, []).append(("notice", label, weight, len(phrase)))
    for phrase in TAG_WORDS:
        entries.setdefault(phrase, []).append(("tag", "", 0.0, len(phrase)))
    for phrase, hits in entries.items():
        found.add_word(f" {phrase} ", hits)
    found.make_automaton()
    return found


def scan_text(text: str | None) -> tuple:
    """The columns of ``FIELDS`` without the id, for one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")  # a byte is a character: places stay cheap
    places, base, labels, misses, tagged = 0, set(), set(), {}, False
    first = last = None
    word = counted = 0
    for end, hits in automaton().iter(line):
        for kind, label, weight, size in hits:
            if kind == "tag":
                tagged = True
                continue
            labels.add(label)
            misses[label] = min(misses.get(label, 1.0), 1 - weight)
            if kind == "base":
                base.add(label)
                places += 1
                start = end - size - 1  # of the space before the phrase
                word += line.count(" ", counted, start) if start >= counted else -line.count(" ", start, counted)
                counted = start
                first = word if first is None else min(first, word)
                last = word if last is None else max(last, word)
    expressions, free = [], None
    if tagged:
        for found in TAG.finditer(text):
            if parsed := parse_expression(found[1]):
                expressions.append(parsed[0])
                labels |= parsed[1]
                for label in parsed[1]:
                    misses[label] = min(misses.get(label, 1.0), 1 - EXPRESSION_WEIGHT)
                free = parsed[2] if free is None else min(free, parsed[2])
    if free is None and labels:
        free = min(permissiveness for label in labels for name, permissiveness in FAMILIES.values() if name == label)
    score = 1.0
    for miss in misses.values():
        score *= miss
    return (
        len(words), places, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - score, 6),
        ";".join(sorted(set(expressions))), free,
    )


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the columns of ``FIELDS``."""

    def block(ids: list, texts: list) -> dict[str, list]:
        rows = [scan_text(text) for text in texts]
        columns = list(zip(*rows)) if rows else [[] for _ in range(len(FIELDS) - 1)]
        return dict(zip(FIELDS, [ids, *columns]))

    source: dict[str, Column] = {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col)}
    return map_blocks(df, source, FIELDS, block)

"""Secret scan: base patterns, and assignment-aware lexing that scores literals by the names they reach.

The lexer reads source and configuration syntax (``name = "x"``, ``name: "x"``, ``"name": "x"``, ``name => "x"``, call
arguments, ``export NAME=x`` and bare ``KEY=value`` lines) into name-value pairs in the order of the text. A value is a
sequence of quoted literals and names joined by ``+`` or ``.``. Constants propagate: a name that was given a literal hands
its spans on to whatever name is set from it, through any number of hops, and the latest assignment before a use counts.
A literal's score multiplies the sensitivity of the target name's parts with the shape of the literal (length, entropy,
character classes, placeholders).

Spans are ``kind:start:end`` in code points, end exclusive. Base kinds are found as their patterns say; the method adds
``literal`` (assigned to a sensitive name itself) and ``constant`` (reached through other names). An added span that lies
inside a base span is not repeated.

Defined results: a null text counts as empty. Each input row gives one output row, repeated rows and null ids included.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import map_blocks

#: The base patterns of the contract; a run of too few characters matches nothing, as a dropped match would.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "literal", "constant")

#: How much the parts of a name say that its value is secret.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.8, "private": 0.5, "access": 0.4, "auth": 0.6, "signing": 0.5, "encryption": 0.5, "api": 0.4,
    "key": 0.5, "client": 0.2, "jwt": 0.7, "webhook": 0.5, "dsn": 0.6, "session": 0.3,
}
#: Parts that say the opposite: public halves, descriptions, places.
NAME_DISCOUNTS = {"public": 0.2, "name": 0.3, "path": 0.3, "file": 0.3, "url": 0.5, "field": 0.2, "label": 0.2, "type": 0.2, "hint": 0.1, "length": 0.0, "count": 0.0, "max": 0.1, "min": 0.1, "regex": 0.1, "env": 0.3, "id": 0.5}
PLACEHOLDER = re.compile(r"(?ai:^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(?.*\)?s?|your.*|change.?me.*|example.*|dummy.*|test|todo|none|null|true|false|undefined)$)")
THRESHOLD = 0.45

_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z_$][A-Za-z0-9_$]*)*"
_QUOTED = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`\n]*`'
# The name is found from the operator backwards (``_TARGET``): a forward search for names would visit every word of prose.
_OPERATOR = re.compile(r"(?::=|=>|=(?!=)|:(?!:))")
_TARGET = re.compile(r"(?:([\"'`])(" + _NAME + r")\1|(" + _NAME + r"))(?:\[[^\]\n]{0,40}\])?[\t ]*(?::[\t ]*" + _NAME + r"[\t ]*)?$")
_VALUE = re.compile(r"[\t ]*(?:(" + _QUOTED + r")|(" + _NAME + r"))")
_JOIN = re.compile(r"[\t ]*(?:\+|\.\.?(?=[\t ]))")
_BARE = re.compile(r"[\t ]*([^\s\"'`#;,(){}\[\]]+)[\t ]*(?=\r?$|\r?\n|#|;)", re.M)
_BARE_LINE = re.compile(r"[\t ]*(?:export[\t ]+|set[\t ]+|ENV[\t ]+|-[\t ]+)?$")
#: A name and what may stand between it and its operator fit in this many characters; longer names are no identifiers.
TARGET_REACH = 200
FIELDS = {"doc_id": "long", "n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    """Between 0 and 1: the sensitive parts of a name, less what its other parts take back."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
    keep = 1.0
    for part in parts:
        keep *= 1 - NAME_WEIGHTS.get(part, 0.0)
    for part in parts:
        keep = 1 - (1 - keep) * NAME_DISCOUNTS.get(part, 1.0)
    return 1 - keep


def literal_score(value: str) -> float:
    """Between 0 and 1: how much a literal looks like a secret rather than a word, a sentence or a placeholder."""
    if len(value) < 6 or PLACEHOLDER.match(value) or re.search(r"\s", value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.25 + 0.12 * entropy + 0.1 * (classes - 1) + 0.005 * min(len(value), 40))


def pairs(text: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Names and their values in order; a value is a list of (``literal`` or ``name``, start, end)."""
    out = []
    line_start, at = 0, 0
    for op in _OPERATOR.finditer(text):
        if op.start() < at:
            continue  # inside a value that was read already
        line_start = text.rfind("\n", max(0, op.start() - TARGET_REACH), op.start()) + 1 or max(0, op.start() - TARGET_REACH)
        before = text[line_start : op.start()]
        if not (target := _TARGET.search(before)):
            continue
        name, value, end = target[2] or target[3], [], op.end()
        while part := _VALUE.match(text, end):
            value.append(("literal", part.start(1) + 1, part.end(1) - 1) if part[1] else ("name", part.start(2), part.end(2)))
            end = part.end()
            if not (joined := _JOIN.match(text, end)):
                break
            end = joined.end()
        plain = not any(kind == "literal" for kind, _, _ in value)
        if plain and op[0] in "=:" and _BARE_LINE.match(before[: target.start()]) and (bare := _BARE.match(text, op.end())):
            word = bare[1]
            if op[0] == "=" and before[-1:] not in " \t" and not bare[0].startswith((" ", "\t")) or re.search("[0-9]", word):
                value.append(("bare", bare.start(1), bare.end(1)))
                end = bare.end(1)
        if value:
            out.append((name, value))
            at = end
    return out


def method_spans(text: str) -> list[tuple[str, int, int]]:
    """Each assignment is a node that points at the assignments its names were last set by; the most sensitive targets walk
    the graph first, and a node that a more sensitive target has reached has nothing left to give to a lesser one."""
    latest: dict[str, int] = {}
    own, sources, targets = [], [], []
    for node, (name, value) in enumerate(pairs(text)):
        own.append([(s, e) for kind, s, e in value if kind != "name"])
        sources.append([latest[text[s:e]] for kind, s, e in value if kind == "name" and text[s:e] in latest])
        latest[name] = node
        if weight := name_score(name):
            targets.append((-weight, node))
    found: dict[tuple[int, int], str] = {}

    def take(kind: str, weight: float, node: int) -> None:
        for s, e in own[node]:
            if weight * literal_score(text[s:e]) >= THRESHOLD:
                found.setdefault((s, e), kind)

    for weight, node in targets:
        take("literal", -weight, node)
    reached: set[int] = set()
    for weight, node in sorted(targets):
        todo = list(sources[node])
        while todo:
            if (at := todo.pop()) not in reached:
                reached.add(at)
                take("constant", -weight, at)
                todo += sources[at]
    return [(kind, s, e) for (s, e), kind in found.items()]


def scan_text(text: str | None) -> tuple:
    text = text or ""
    rank = {kind: i for i, kind in enumerate(KINDS)}
    order = lambda span: (span[1], rank[span[0]], span[2])
    base = sorted(base_spans(text), key=order)
    extra = [
        span for span in (method_spans(text) if "=" in text or ":" in text else ())
        if not any(b[1] <= span[1] and span[2] <= b[2] for b in base)
    ]
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    counts = Counter(kind for kind, _, _ in base)
    digest = hashlib.sha256(join(base).encode()).hexdigest()
    return counts["assign"], counts["access"], counts["hex"], digest, join(sorted(base + extra, key=order))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the columns of ``FIELDS``."""

    def block(ids: list, texts: list) -> dict[str, list]:
        rows = [scan_text(text) for text in texts]
        columns = list(zip(*rows)) if rows else [[] for _ in range(len(FIELDS) - 1)]
        return dict(zip(FIELDS, [ids, *columns]))

    return map_blocks(df, {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col)}, FIELDS, block)

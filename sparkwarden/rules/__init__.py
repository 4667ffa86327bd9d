"""Rule catalogues.

A rule is data: the detectors turn a list of rules into one array literal in the plan. ``anchors`` are strings of which
every match must contain at least one (lower case where the rule ignores case), ``symbols`` likewise single characters.
The scan tests both with plain substring searches before any regular expression runs; they never change a result.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    id: str
    pattern: str
    flags: str
    severity: str
    type: str
    message: str
    suggestion: str | None
    layer: str
    anchors: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ("",)
    languages: tuple[str, ...] = ()

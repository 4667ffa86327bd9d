"""Detectors over a corpus ``(file, text, language)``; each returns finding records."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from ..rules import Rule
from ..rules.ai_patterns import AI_PATTERN_RULES
from ..rules.config import CONFIG_RULES
from ..rules.sast import SAST_RULES
from .fixes import mechanical_replacement, secret_environment_fix
from .secrets import LITERAL_RULE, SECRET_RULES, judge_secrets, plausible_secret, redacted_evidence, suppress_overlaps
from .spans import rule_spans, to_findings

# Order in which the detectors report; the first report of a position wins.
SECRETS, CONFIG, AI_PATTERNS, PACKAGES, SAST, REVIEW, CUSTOM = range(7)


def scan_config_rules(corpus: DataFrame, now: int) -> DataFrame:
    spans = rule_spans(corpus, CONFIG_RULES)
    return to_findings(spans, now, fix=mechanical_replacement(F.col("rule.id"), F.col("match")), detector=CONFIG)


def scan_ai_patterns(corpus: DataFrame, now: int) -> DataFrame:
    """The rules list languages for reference only: every rule runs on every text."""
    rules = [r._replace(languages=()) for r in AI_PATTERN_RULES]
    return to_findings(rule_spans(corpus, rules), now, detector=AI_PATTERNS)


def scan_sast_patterns(corpus: DataFrame, now: int) -> DataFrame:
    spans = rule_spans(corpus, SAST_RULES, groups=2, where=None, context_rules=["sast_sql_python_f_string_execute"])
    fix = mechanical_replacement(F.col("rule.id"), F.col("match"), F.col("context"))
    return to_findings(spans, now, fix=fix, detector=SAST)


def scan_secrets(corpus: DataFrame, now: int, kinds: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Provider signatures (0), sensitive assignments (1) and random literals (2), evidence redacted."""
    matches = rule_spans(corpus, SECRET_RULES, groups=2, where=plausible_secret, context_rules=[LITERAL_RULE])
    spans = suppress_overlaps(judge_secrets(matches)).filter(F.col("kind").isin(list(kinds)))
    return to_findings(spans, now, evidence=redacted_evidence(F.col("name"), F.col("value")), fix=_environment_fix(), detector=SECRETS)


def _environment_fix() -> Column:
    asked = F.when(F.col("kind") == 1, F.col("match"))
    return secret_environment_fix(F.col("file"), F.col("name"), F.col("value"), asked)


def scan_catalogue(
    corpus: DataFrame, now: int, layers: Sequence[str] = ("L1", "L2"), custom: Sequence[Rule] = ()
) -> DataFrame:
    """Every text rule of the switched-on layers in one read of the corpus.

    Secrets, configuration, generated-code patterns, source rules and custom rules all travel through the same scan; the
    only shuffle is by file, over the matches, for the precedence among secrets.
    """
    rules: list[Rule] = []
    detector: list[tuple[str, int]] = []
    groups = []
    if "L1" in layers:
        groups += [(SECRETS, SECRET_RULES), (CONFIG, CONFIG_RULES)]
        groups += [(AI_PATTERNS, [r._replace(languages=()) for r in AI_PATTERN_RULES])]
    if "L2" in layers:
        groups += [(SAST, SAST_RULES)]
    groups += [(CUSTOM, [r for r in custom if r.layer in layers])]
    for number, members in groups:
        rules += members
        detector += [(r.id, number) for r in members]
    if not rules:
        return corpus.sparkSession.createDataFrame([], schema.FINDING_DDL + ", _detector int, _order struct<rule:int,start:int>")

    context = [LITERAL_RULE, "sast_sql_python_f_string_execute"]
    spans = rule_spans(corpus, rules, groups=2, where=plausible_secret, context_rules=context)
    source = F.when(F.col("rule.id") == context[1], F.col("context"))
    numbers = F.create_map(*[F.lit(x) for pair in detector for x in pair])
    spans = spans.withColumn("_fix", mechanical_replacement(F.col("rule.id"), F.col("match"), source)).withColumn(
        "_number", F.try_element_at(numbers, F.col("rule.id"))
    )
    judged = suppress_overlaps(judge_secrets(spans)) if "L1" in layers else spans.withColumn("kind", F.lit(None).cast("int"))
    shown = F.when(F.col("kind").isNotNull(), redacted_evidence(F.col("name"), F.col("value"))).otherwise(
        tx.compact_evidence(F.col("match"))
    ) if "L1" in layers else None
    fix = F.coalesce("_fix", _environment_fix()) if "L1" in layers else F.col("_fix")
    out = to_findings(judged, now, evidence=shown, fix=fix, detector=F.col("_number"))
    return out


_RULE_ID = re.compile(r"^[A-Za-z0-9_.-]+$")
# Types a custom rule may carry: all but the two that were added to findings later.
CUSTOM_TYPES = [t for t in schema.FINDING_TYPES if t not in ("open_redirect", "information_leakage")]


def parse_custom_rules(entries: Sequence[Mapping]) -> list[Rule]:
    """Validate user rules (configuration, so driver-side) and name them ``custom.<id>``."""
    rules = []
    for i, entry in enumerate(entries):
        where = f"rules[{i}]"

        def need(field: str, value) -> str:
            if not isinstance(value, str) or not value.strip():
                raise ValueError(f"{where}.{field}: expected a non-empty string.")
            return value.strip()

        id = need("id", entry.get("id"))
        if not _RULE_ID.match(id):
            raise ValueError(f"{where}.id: use only letters, numbers, dot, underscore, or hyphen.")
        pattern = need("pattern", entry.get("pattern", entry.get("regex")))
        flags = entry.get("flags") or ""
        if not isinstance(flags, str) or set(flags) - set("gimsuy"):
            raise ValueError(f"{where}.flags: invalid flags.")
        try:
            empty = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).search("")
        except re.error as error:
            raise ValueError(f"{where}.pattern: {error}") from None
        if empty:
            raise ValueError(f"{where}.pattern: must not match the empty string.")
        severity = need("severity", entry.get("severity")).lower()
        if severity not in schema.SEVERITIES:
            raise ValueError(f'{where}.severity: invalid severity "{severity}".')
        kind = need("type", entry.get("type") or "other")
        if kind not in CUSTOM_TYPES:
            raise ValueError(f'{where}.type: invalid finding type "{kind}".')
        layer = (entry.get("layer") or entry.get("detection_layer") or "L1").upper()
        if layer not in schema.LAYERS:
            raise ValueError(f'{where}.layer: invalid detection layer "{layer}".')
        languages = entry.get("languages") or ()
        if not isinstance(languages, (list, tuple)):
            raise ValueError(f"{where}.languages: expected an array of language ids or file extensions.")
        suggestion = entry.get("suggestion")
        if suggestion is not None and not isinstance(suggestion, str):
            raise ValueError(f"{where}.suggestion: expected a string.")
        rules.append(
            Rule(f"custom.{id}", pattern, flags, severity, kind, need("message", entry.get("message")), suggestion,
                 layer, (), ("",), tuple(need("languages", x) for x in languages))
        )
    return rules


def scan_custom_rules(
    corpus: DataFrame, rules: Sequence[Rule], now: int, layers: Sequence[str] = ("L1", "L2", "L3")
) -> DataFrame:
    """Findings of validated user rules whose layer is switched on and whose languages fit the text."""
    active = [r for r in rules if r.layer in layers]
    return to_findings(rule_spans(corpus, active), now, detector=CUSTOM)

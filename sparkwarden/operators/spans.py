"""Regex matches as rows: offsets, line/column positions and finding records.

Spark has no "find all with offsets" function. The text is cut twice by the same pattern, into the matches and into the
pieces between them; the i-th offset is the length of everything before it. Line and column come from the same running
sum, so a text is read a fixed number of times however many matches it holds and nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from ..rules import Rule

# Positions are summed in two levels so that a text with very many matches stays near-linear.
_CHUNK = 256
_FEW_RULES = 16
_RULE_TYPE = (
    "array<struct<ordinal:int,id:string,folded:boolean,symbols:array<string>,anchors:array<string>,"
    "languages:array<string>,severity:string,type:string,message:string,suggestion:string,layer:string>>"
)
_STATE = "struct<off:int,nl:int,col:int>"


def _newlines(s: str) -> str:
    return f"(length({s}) - length(replace({s}, '\\n', '')))"


def _tail(s: str) -> str:
    return f"length(substring_index({s}, '\\n', -1))"


def _advance(state: str, part: str) -> str:
    """Position after reading ``part`` (length, line breaks, characters since the last line break)."""
    return (
        f"named_struct('off', {state}.off + {part}.len, 'nl', {state}.nl + {part}.nl, "
        f"'col', if({part}.nl > 0, {part}.tail, {state}.col + {part}.len))"
    )


def _measure(s: str) -> str:
    return f"named_struct('len', length({s}), 'nl', {_newlines(s)}, 'tail', {_tail(s)})"


_MARK = "\uffff"


def by_pattern(pattern: str | Column | dict[int, str], text: str, call: Callable[[str, str], str]) -> Column:
    """A call of (text, pattern) with the pattern as SQL constant, per rule where there are several.

    The choice among many rules sits in a lambda: lambdas are interpreted, so the rules do not pile up in one generated
    method.
    """
    quote = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(pattern, str):
        return F.expr(call(f"`{text}`", quote(pattern)))
    if isinstance(pattern, Column):
        return F.expr(call(f"`{text}`", "_p"))
    branches = " ".join(f"WHEN {i} THEN {call('t', quote(p))}" for i, p in pattern.items())
    return F.expr(f"transform(array(`{text}`), t -> CASE rule.ordinal {branches} END)[0]")


def regex_spans(
    df: DataFrame,
    pattern: str | Column | dict[int, str],
    text: str = "text",
    groups: int = 0,
    keep: Sequence[str] | None = None,
    where: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per match of ``pattern``: ``match``, ``start``/``end`` (0-based characters), 1-based ``line``/``column``
    and ``end_line``/``end_column``, the ``ordinal`` within the text and ``g1..gN`` for capture groups.

    The pattern may be a column, or a dict by the row's ``rule.ordinal``, so that different rows use different rules; the
    dict keeps every pattern a constant, compiled once per task. A pattern must not match the empty string.
    ``where`` keeps a match by its ``match``/``g1..gN`` before it becomes a row.
    """
    keep = list(df.columns) if keep is None else list(keep)
    state0 = "named_struct('off', 0, 'nl', 0, 'col', 0)"
    group_names = [f"g{i}" for i in range(1, groups + 1)]

    # One pass of the pattern marks each match and its groups; cutting at the marks gives, match after match, the piece before
    # it, the match and the groups. A text that holds the mark itself is read once for the matches, the pieces and each group.
    extract = lambda group: by_pattern(pattern, text, lambda t, p: f"regexp_extract_all({t}, {p}, {group})")
    marks = _MARK.join(["", *[f"${i}" for i in range(groups + 1)], ""])
    marked = by_pattern(pattern, text, lambda t, p: f"regexp_replace({t}, {p}, '{marks}')")
    pieces = by_pattern(pattern, text, lambda t, p: f"split({t}, {p}, -1)")
    read = F.filter(F.arrays_zip(pieces, *[extract(i) for i in range(groups + 1)]), lambda x: x["1"].isNotNull())
    width = groups + 2
    plain = F.flatten(F.transform(read, lambda x: F.array(*[x[str(i)] for i in range(width)])))
    cut = df if not isinstance(pattern, Column) else df.withColumn("_p", pattern)
    cut = cut.select("*", F.when(F.contains(F.col(text), F.lit(_MARK)), plain).otherwise(F.split(marked, _MARK, -1)).alias("_f"))

    captured = "".join(f", '{g}', _f[i * {width} + {k + 2}]" for k, g in enumerate(group_names))
    places = f"slice(sequence(0, size(_f) div {width}), 1, size(_f) div {width})"
    items = F.expr(
        f"CASE WHEN size(_f) >= {width} THEN transform({places}, i -> named_struct('match', _f[i * {width} + 1], "
        f"'a', {_measure(f'_f[i * {width}]')}, 'b', {_measure(f'_f[i * {width} + 1]')}{captured})) END"
    )
    # Lambdas are interpreted and share nothing, so a state that is named several times is bound first.
    bind = lambda value, name, use: f"transform(array({value}), {name} -> {use})[0]"
    fold = lambda arr, start: (
        f"aggregate({arr}, {start}, (st, e) -> {bind(_advance('st', 'e.a'), 'p', _advance('p', 'e.b'))})"
    )
    fields = "".join(f", {g}:string" for g in group_names)
    out_type = f"array<struct<match:string,a:{_STATE},b:{_STATE}{fields}>>"
    copied = "".join(f", '{g}', e.{g}" for g in group_names)
    grown = f"named_struct('st', q, 'out', array_append(acc.out, named_struct('match', e.match, 'a', p, 'b', q{copied})))"
    walk = (
        "aggregate(ch, named_struct('st', st0, 'out', cast(array() as " + out_type + ")), "
        f"(acc, e) -> {bind(_advance('acc.st', 'e.a'), 'p', bind(_advance('p', 'e.b'), 'q', grown))}, acc -> acc.out)"
    )
    numbers = f"slice(sequence(0, size(_items) div {_CHUNK}), 1, int((size(_items) + {_CHUNK - 1}) div {_CHUNK}))"
    chunks = f"transform({numbers}, c -> slice(_items, int(c * {_CHUNK} + 1), {_CHUNK}))"
    # A single chunk, as most texts have, starts at the start.
    starts = (
        f"if(size(_chunks) = 1, array({state0}), "
        f"aggregate(_chunks, named_struct('st', {state0}, 'out', cast(array() as array<{_STATE}>)), "
        f"(acc, ch) -> named_struct('st', {fold('ch', 'acc.st')}, 'out', array_append(acc.out, acc.st)), acc -> acc.out))"
    )
    found = F.expr(f"flatten(zip_with(_chunks, _starts, (ch, st0) -> {walk}))")
    spans = (
        cut.withColumn("_items", items)
        .withColumn("_chunks", F.expr(chunks))
        .withColumn("_starts", F.expr(starts))
        .select(*keep, F.posexplode(found if where is None else F.filter(found, where)).alias("ordinal", "_e"))
    )
    return spans.select(
        *keep,
        "ordinal",
        F.col("_e.match").alias("match"),
        F.col("_e.a.off").alias("start"),
        F.col("_e.b.off").alias("end"),
        (F.col("_e.a.nl") + 1).alias("line"),
        (F.col("_e.a.col") + 1).alias("column"),
        (F.col("_e.b.nl") + 1).alias("end_line"),
        (F.col("_e.b.col") + 1).alias("end_column"),
        *[F.col(f"_e.{g}").alias(g) for g in group_names],
    )


def with_positions(df: DataFrame, offset: str, text: str = "text", prefix: str = "") -> DataFrame:
    """1-based line and column of a character offset carried next to its text."""
    head = F.left(F.col(text), F.col(offset))
    return df.withColumn(
        f"{prefix}line", F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    ).withColumn(f"{prefix}column", F.length(F.substring_index(head, "\n", -1)) + 1)


def group_count(pattern: str) -> int:
    return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern).replace(r"\z", r"\Z")).groups


def rule_patterns(rules: Sequence[Rule], groups: int = 0) -> dict[int, str]:
    """Patterns by ordinal. Rules with fewer than ``groups`` capture groups get empty ones, so that one expression serves
    all of them."""
    pad = lambda p: f"(?:{p})" + "()" * max(0, groups - group_count(p))
    return {i: tx.java_regex(pad(r.pattern), r.flags) for i, r in enumerate(rules)}


def rule_array(rules: Sequence[Rule]) -> Column:
    """The catalogue as one literal; ``ordinal`` keeps the order in which rules are evaluated."""
    rows = [
        {
            "ordinal": i,
            "id": r.id,
            "folded": "i" in r.flags,
            "symbols": r.symbols,
            "anchors": r.anchors,
            "languages": [x.lower() for x in r.languages],
            "severity": r.severity,
            "type": r.type,
            "message": r.message,
            "suggestion": r.suggestion,
            "layer": r.layer,
        }
        for i, r in enumerate(rules)
    ]
    # One constant, folded by the optimizer.
    return F.from_json(F.lit(json.dumps(rows)), _RULE_TYPE)


def _fitting(corpus: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, Column]:
    """``corpus(file, text, language, ...)`` with helper columns, and over them the rules that fit the row's text."""
    use_languages = any(r.languages for r in rules)
    symbols = sorted({s for r in rules for s in r.symbols})
    folded = sorted({s for r in rules if "i" in r.flags for s in r.symbols})
    literal = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    kinds = F.array_compact(F.array(F.lower("language"), tx.extension(F.col("file")), F.lower(tx.basename(F.col("file")))))
    base = corpus.select("*", kinds.alias("_kinds"), F.filter(literal(symbols), lambda s: F.contains(F.col("text"), s)).alias("_symbols"))
    base = base.withColumn("_lower", F.when(F.arrays_overlap("_symbols", literal(folded)), F.lower("text")))

    if len(rules) <= _FEW_RULES and not use_languages:
        # Few rules are tried in generated code; lambdas, which many need, are interpreted.
        some = lambda text, parts: reduce(or_, [F.contains(F.col(text), F.lit(x)) for x in parts], F.lit(False))
        fits = lambda r: some("text", r.symbols) & (some("_lower" if "i" in r.flags else "text", r.anchors) if r.anchors else F.lit(True))
        each = rule_array(rules)
        return base, F.array_compact(F.array(*[F.when(fits(r), F.get(each, F.lit(i))) for i, r in enumerate(rules)]))

    def applies(rule: Column) -> Column:
        found = lambda a: F.when(rule["folded"], F.contains(F.col("_lower"), a)).otherwise(F.contains(F.col("text"), a))
        anchored = F.arrays_overlap(rule["symbols"], F.col("_symbols")) & (
            (F.size(rule["anchors"]) == 0) | F.exists(rule["anchors"], found)
        )
        if not use_languages:
            return anchored
        return ((F.size(rule["languages"]) == 0) | F.arrays_overlap(rule["languages"], F.col("_kinds"))) & anchored

    return base, F.filter(rule_array(rules), applies)


def applicable(corpus: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``corpus(file, text, language, ...)`` with ``_rules``: the rules whose symbols, anchors and languages fit the row's text.

    Most texts cost a few substring searches. Rules that name languages apply to texts of that language, extension or file
    name.
    """
    base, fitting = _fitting(corpus, rules)
    return base.select(*corpus.columns, fitting.alias("_rules"))


def rule_spans(
    corpus: DataFrame,
    rules: Sequence[Rule],
    groups: int = 0,
    where: Callable[[Column], Column] | None = None,
    context_rules: Sequence[str] = (),
) -> DataFrame:
    """Matches of every rule in one pass over ``corpus(file, text, language)``.

    No shuffle: each row is scanned where it was read, and a text meets only the patterns of its ``applicable`` rules. The
    text itself stays on the rows of ``context_rules`` only.
    """
    # The array is exploded where it is built. From a named array Spark infers a filter on its size, moves it down to the
    # table and there works out the text anew for each symbol and rule.
    base, fitting = _fitting(corpus.select("file", "text", "language"), rules)
    candidates = base.select("file", "text", F.explode(fitting).alias("rule"))
    keep = ["file", "rule"]
    if context_rules:
        candidates = candidates.withColumn("context", F.when(F.col("rule.id").isin(list(context_rules)), F.col("text")))
        keep.append("context")
    return regex_spans(candidates, rule_patterns(rules, groups), groups=groups, keep=keep, where=where)


def running(df: DataFrame, items: str, out: str, state: tuple[str, str], step: str, emit: str, kind: str) -> DataFrame:
    """``df`` with ``out``, an array: for every element ``e`` of the array ``items``, in order, ``emit`` of the state ``st`` before it.

    ``state`` is the first state and its type, ``step`` the state after ``e``, ``kind`` the type of an emitted element. The
    array is walked in chunks, whose first states are found beforehand, so that long arrays stay near-linear.
    """
    numbers = f"slice(sequence(0, size({items}) div {_CHUNK}), 1, int((size({items}) + {_CHUNK - 1}) div {_CHUNK}))"
    chunks = f"transform({numbers}, c -> slice({items}, int(c * {_CHUNK} + 1), {_CHUNK}))"
    first, held = state
    starts = (
        f"aggregate(_chunks, named_struct('st', {first}, 'out', cast(array() as array<{held}>)), (acc, ch) -> named_struct("
        f"'st', aggregate(ch, acc.st, (st, e) -> {step}), 'out', array_append(acc.out, acc.st)), acc -> acc.out)"
    )
    bind = lambda expression: f"transform(array(acc.st), st -> {expression})[0]"
    walk = (
        f"aggregate(ch, named_struct('st', st0, 'out', cast(array() as array<{kind}>)), (acc, e) -> named_struct("
        f"'st', {bind(step)}, 'out', array_append(acc.out, {bind(emit)})), acc -> acc.out)"
    )
    walked = df.withColumn("_chunks", F.expr(chunks)).withColumn("_starts", F.expr(starts))
    return walked.withColumn(out, F.expr(f"flatten(zip_with(_chunks, _starts, (ch, st0) -> {walk}))")).drop("_chunks", "_starts")


def spans_in_row(corpus: DataFrame, rules: Sequence[Rule], groups: int = 0) -> DataFrame:
    """``corpus`` with ``_spans``, the matches of all rules beside the text they stand in: ``id``, ``match``, ``start``, ``end``, ``g1..gN``.

    Nothing is exploded and nothing shuffled, so a result that needs text and matches together costs one read and no join.
    """
    patterns = rule_patterns(rules, groups)
    quote = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    per_rule = lambda call: "CASE c.rule.ordinal " + " ".join(f"WHEN {i} THEN {call(quote(p))}" for i, p in patterns.items()) + " END"
    extract = lambda group: per_rule(lambda p: f"regexp_extract_all(`text`, {p}, {group})")
    pieces = (
        f"if(contains(`text`, '{_MARK}'), {per_rule(lambda p: f'split(`text`, {p}, -1)')}, "
        f"split({per_rule(lambda p: f'regexp_replace(`text`, {p}, {chr(39)}{_MARK}{chr(39)})')}, '{_MARK}', -1))"
    )
    names = [f"g{i}" for i in range(1, groups + 1)]
    cut = applicable(corpus, rules).withColumn("_cut", F.expr("transform(_rules, r -> named_struct('rule', r))"))
    cut = cut.withColumn("_cut", F.expr(f"filter(transform(_cut, c -> named_struct('rule', c.rule, 'm', {extract(0)})), c -> size(c.m) > 0)"))
    captured = "".join(f", '{g}', {extract(i + 1)}" for i, g in enumerate(names))
    cut = cut.withColumn("_cut", F.expr(f"transform(_cut, c -> named_struct('rule', c.rule, 'm', c.m, 's', {pieces}{captured}))"))
    each = "".join(f", '{g}', c.{g}[i]" for g in names)
    items = (
        "flatten(transform(_cut, c -> transform(c.m, (x, i) -> named_struct('first', i = 0, 'id', c.rule.id, 'match', x, "
        f"'gap', length(c.s[i]), 'len', length(x){each}))))"
    )
    cut = cut.withColumn("_items", F.expr(items))
    copied = "".join(f", '{g}', e.{g}" for g in names)
    begin = "if(e.first, 0, st) + e.gap"
    emit = f"named_struct('id', e.id, 'match', e.match, 'start', {begin}, 'end', {begin} + e.len{copied})"
    kind = "struct<id:string,match:string,start:int,end:int" + "".join(f",{g}:string" for g in names) + ">"
    found = running(cut, "_items", "_spans", ("0", "int"), f"{begin} + e.len", emit, kind)
    return found.drop("_rules", "_cut", "_items")


def to_findings(
    spans: DataFrame,
    now: int | Column,
    evidence: Column | None = None,
    fix: Column | None = None,
    detector: int = 0,
) -> DataFrame:
    """Finding records from spans that carry ``file``, ``rule`` and positions.

    Two helper columns keep the order in which the findings were produced: ``_detector`` and ``_order``.
    """
    shown = tx.compact_evidence(F.col("match")) if evidence is None else evidence
    described = (
        F.when(
            fix.isNotNull(),
            F.struct(
                F.concat(F.lit("Replace with "), fix).alias("description"),
                F.array(
                    F.struct(
                        F.col("line").alias("startLine"),
                        F.col("column").alias("startColumn"),
                        F.col("end_line").alias("endLine"),
                        F.col("end_column").alias("endColumn"),
                        fix.alias("newText"),
                    )
                ).alias("edits"),
            ),
        )
        if fix is not None
        else F.lit(None)
    )
    rows = spans.withColumn("evidence", shown)
    return rows.select(
        tx.stable_id(F.col("file"), F.col("rule.id"), F.col("line"), F.col("column"), F.col("evidence")).alias("id"),
        F.col("rule.type").alias("type"),
        F.col("rule.severity").alias("severity"),
        F.col("rule.message").alias("message"),
        "file",
        "line",
        "column",
        "end_line",
        "end_column",
        "evidence",
        F.col("rule.suggestion").alias("suggestion"),
        described.cast(schema.FIX).alias("fix"),
        F.lit(None).cast(f"array<{schema.FIX}>").alias("alternative_fixes"),
        F.col("rule.layer").alias("detection_layer"),
        F.col("rule.id").alias("detection_rule"),
        F.lit(now).cast("bigint").alias("timestamp"),
        F.lit(False).alias("dismissed"),
        F.lit(None).cast("string").alias("dismissed_reason"),
        F.lit(detector).alias("_detector"),
        F.struct(F.col("rule.ordinal").alias("rule"), F.col("start").alias("start")).alias("_order"),
    )

"""Similar-name search: exact top-k without scoring all pairs.

Every name that could rank is reached:

* containment: a substring of the missing name equals the candidate, or both share the gram at the front of the shorter;
* plain names: blocks of names are compared bit by bit (``edits``), first within two edits, then, for names that are still open,
  within what their k-th best score leaves room for;
* scoped names, whose leaves and full names count: for an edit distance of at most t, of t+1 pieces of the candidate at least one
  occurs in the missing name, shifted by no more than the edits on either side of it. Piece, place and both lengths form the join
  key. Rounds widen the search: t = 1 for every name, then t = 2, then the full plausibility limit.

A name goes into the next round only while its k-th best score does not beat everything that the rounds so far cannot have seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import index_key
from ..session import ensure_checkpoint_dir
from .edits import close_pairs

# Fixed values of the score.
SUBSTRING_BONUS, PREFIX_BONUS = -0.35, -0.15
_GRAM = 6
# Pieces of missing names that a task may hold at once.
_FEW = 200_000
_PAIR = ["registry", "query", "candidate", "_q", "_ql", "_c", "_cl"]


def leaf(name: Column) -> Column:
    """Last non-empty part of a scoped, path-like or coordinate name."""
    parts = F.filter(F.split(name, "[/:]", -1), lambda p: p != "")
    return F.coalesce(F.get(parts, F.size(parts) - 1), name)


def _prepared(df: DataFrame, name: str, key: str) -> DataFrame:
    """Normalised full name and leaf next to each name, computed once per name instead of once per pair."""
    return (
        df.select("registry", F.col("package_name").alias(name))
        .distinct()
        .withColumn(f"_{key}", index_key(F.col(name)))
        .withColumn(f"_{key}l", leaf(F.col(f"_{key}")))
        .filter(F.col(f"_{key}") != "")
    )


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Score and plausibility of prepared name pairs; implausible pairs are dropped."""
    plain = (F.col("_q") == F.col("_ql")) & (F.col("_c") == F.col("_cl"))
    leaf = F.when(plain, F.col("_full")).otherwise(F.levenshtein("_ql", "_cl"))
    inside = F.contains("_c", "_q") | F.contains("_q", "_c") | F.contains("_cl", "_ql") | F.contains("_ql", "_cl")
    # As a generated row a value is worked out once; a filter on a plain column would work it out anew at every mention.
    once = lambda df, **columns: df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    rows = once(pairs.filter("_q <> _c"), _full=F.levenshtein("_q", "_c"))
    rows = (
        once(rows, distance=F.least("_full", leaf), _inside=inside)
        .withColumn("_ml", F.greatest(F.length("_ql"), F.length("_cl")))
        .withColumn("_mf", F.greatest(F.length("_q"), F.length("_c")))
    )
    plausible = (
        (F.col("distance") <= F.greatest(F.lit(2), F.floor(F.col("_ml") * 0.35)))
        | (F.col("_full") <= F.greatest(F.lit(3), F.floor(F.col("_mf") * 0.28)))
        | F.col("_inside")
    )
    prefixed = F.col("_c").startswith(F.left("_q", F.lit(3))) | F.col("_cl").startswith(F.left("_ql", F.lit(3)))
    score = (
        F.col("distance") / F.greatest(F.lit(1), F.col("_ml"))
        + F.col("_full") / F.greatest(F.lit(1), F.col("_mf"))
        + F.when(F.col("_inside"), SUBSTRING_BONUS).otherwise(0.0)
        + F.when(prefixed, PREFIX_BONUS).otherwise(0.0)
    )
    return rows.filter(plausible).withColumn("score", score).drop("_q", "_c", "_ql", "_cl", "_full", "_ml", "_mf", "_inside")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best k distinct candidates per name. A pair found through several keys shares its dense rank with its copies, so
    the rank limit works before the shuffle and only the survivors are made distinct."""
    by = Window.partitionBy("registry", "query").orderBy("score", "distance", "candidate")
    return scored.withColumn("rank", F.dense_rank().over(by)).filter(F.col("rank") <= k).distinct()


# Comparable forms by kind: which names have it, and whether it is the leaf or the full name. Plain names are their own
# leaf, so two of them meet in one form; pairs with a scoped name meet by their leaves and by their full names.
_PLAIN = {"plain": ("plain", "plain", "full")}
_SCOPED = {
    "leaf-scoped-any": ("scoped", "any", "leaf"),
    "leaf-plain-scoped": ("plain", "scoped", "leaf"),
    "full-scoped-any": ("scoped", "any", "full"),
    "full-plain-scoped": ("plain", "scoped", "full"),
}
_ALL = _PLAIN | _SCOPED


def _forms(df: DataFrame, name: str, kinds: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Rows of ``kind, s``: the forms of a name, for missing names (``query``) or those of the index (``candidate``)."""
    key, side = ("q", 0) if name == "query" else ("c", 1)
    form = {"full": F.col(f"_{key}"), "leaf": F.col(f"_{key}l")}
    case = {"any": F.lit(True), "scoped": form["full"] != form["leaf"], "plain": form["full"] == form["leaf"]}
    forms = [F.when(case[x[side]], F.struct(F.lit(kind).alias("kind"), form[x[2]].alias("s"))) for kind, x in kinds.items()]
    return df.withColumn("_form", F.explode(F.array_compact(F.array(*forms)))).select(*df.columns, "_form.*")


def _both_forms(missing: DataFrame, index: DataFrame, kinds: dict[str, tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Forms of both sides, as far as the other side has any of that kind in the registry."""
    asked, held = _forms(missing, "query", kinds), _forms(index, "candidate", kinds)
    met = lambda df: F.broadcast(df.select("registry", "kind").distinct())  # one row per registry and kind
    return asked.join(met(held), ["registry", "kind"], "left_semi"), held.join(met(asked), ["registry", "kind"], "left_semi")


def _pieces(limit: str) -> tuple[str, str]:
    """SQL for the join keys of the candidate side and of the missing-name side under the distance limit ``limit``, an
    expression over the longer length ``{n}``: arrays of both lengths, piece and its place, for names of ``n`` signs."""
    t = lambda a, b: limit.format(n=f"greatest({a}, {b})")
    # The other side's length differs by at most the limit of the longer of the two.
    tt = t("n", "o")
    span = f"filter(sequence(greatest(1, int(n * 0.5) - 3), n * 2 + 3), o -> abs(n - o) <= {tt})"
    start = lambda length, i: f"int(({i} * {length}) div ({tt} + 1))"
    candidate = f"""flatten(transform({span}, o -> transform(sequence(0, {tt}), i ->
        named_struct('ql', o, 'cl', n, 'i', i, 'at', {start('n', 'i')} + 1, 'size', {start('n', '(i + 1)')} - {start('n', 'i')}))))"""
    shift_from = f"greatest(-i, n - o - ({tt} - i), -{start('o', 'i')})"
    shift_to = f"least(i, n - o + ({tt} - i), n - {start('o', '(i + 1)')})"
    query = f"""flatten(transform({span}, o -> flatten(transform(sequence(0, {tt}), i ->
        transform(filter(sequence(-i, i), d -> d >= {shift_from} AND d <= {shift_to}), d ->
          named_struct('ql', n, 'cl', o, 'i', i, 'at', {start('o', 'i')} + d + 1, 'size', {start('o', '(i + 1)')} - {start('o', 'i')}))))))"""
    return candidate, query


_PIECE = ["registry", "kind", "ql", "cl", "i", "piece"]


def _cut(forms: DataFrame, pieces: str) -> DataFrame:
    """A row per piece. Where to cut depends on the length alone, so it is worked out once per length that occurs."""
    places = forms.select(F.length("s").alias("n")).distinct().select("n", F.expr(pieces).alias("_places"))
    rows = forms.withColumn("n", F.length("s")).join(F.broadcast(places), "n").select("*", F.inline("_places"))  # one row per length
    return rows.withColumn("piece", F.expr("substr(s, at, size)")).drop("s", "n", "_places", "at", "size")


# A superset of the plausible distances of both forms.
PLAUSIBLE = "greatest(3, int(floor({n} * 0.35)))"


def near_pairs(
    missing: DataFrame, index: DataFrame, limit: str, kinds: dict[str, tuple[str, str, str]] = _ALL, useful: Column | None = None
) -> DataFrame:
    """Pairs whose full names or leaves may lie within the edit-distance limit (a superset). ``useful`` leaves out pairs by
    the lengths of their forms, ``ql`` and ``cl``, and by what else ``missing`` holds."""
    candidate, query = _pieces(limit)
    asked, forms = _both_forms(missing, index, kinds)
    q = _cut(asked, query) if useful is None else _cut(asked, query).filter(useful)
    # The index has many pieces; where few are looked for, these go to it and not all of it to them.
    q = q.checkpoint()
    few = q.count() <= _FEW
    return _cut(forms, candidate).join(F.broadcast(q) if few else q, _PIECE).select(_PAIR)


def plain_pairs(missing: DataFrame, index: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs of plain names at most ``most`` edits apart; without it, all that may rank beside ``_worst`` of ``missing``."""
    q, c = missing.filter("_q = _ql"), index.filter("_c = _cl")
    worst = F.lit(None).cast("double") if most is not None else F.col("_worst")
    pairs = close_pairs(q.select("registry", F.col("_q").alias("s"), worst.alias("worst")), c.select("registry", F.col("_c").alias("s")), most, -PREFIX_BONUS)
    found = pairs.join(q.select("registry", "query", "_q", "_ql"), ["registry", "_q"])
    return found.join(c.select("registry", "candidate", "_c", "_cl"), ["registry", "_c"]).select(_PAIR)


def containment_pairs(missing: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of which one full name or leaf contains the other (a superset)."""
    qf, cf = _both_forms(missing, index, _ALL)
    parts = F.expr("array_distinct(flatten(transform(sequence(1, length(s)), i -> transform(sequence(1, length(s) - i + 1), n -> substr(s, i, n)))))")
    inside_query = qf.filter("s <> ''").withColumn("part", F.explode(parts)).join(
        cf.withColumnRenamed("s", "part"), ["registry", "kind", "part"]
    )
    # The front of the shorter name, at most _GRAM long, stands in the longer one; only lengths that occur are cut out of it.
    needle = qf.filter("s <> ''").withColumn("gram", F.left("s", F.lit(_GRAM))).withColumnRenamed("s", "needle")
    sizes = F.broadcast(needle.select("registry", "kind", F.length("gram").alias("size")).distinct())
    grams = F.expr("array_distinct(transform(sequence(1, length(s) - size + 1), i -> substr(s, i, size)))")
    cut = cf.join(sizes, ["registry", "kind"]).filter(F.length("s") >= F.col("size")).withColumn("gram", F.explode(grams)).drop("size")
    # As with pieces: the index has many grams, so few missing names go to it.
    inside_candidate = cut.join(F.broadcast(needle) if missing.count() <= _FEW else needle, ["registry", "kind", "gram"])
    inside_candidate = inside_candidate.filter(F.contains("s", "needle"))
    return inside_query.select(_PAIR).unionByName(inside_candidate.select(_PAIR))


def _open(queries: DataFrame, best: DataFrame, k: int, least: int, bonus: float) -> DataFrame:
    """Missing names whose k-th best score, ``_worst``, does not beat every pair at distance ``least`` and more that was not
    seen yet. It is null if there are fewer than k."""
    # Both distances are at least ``least`` and at least what the lengths differ by, and there is no containment.
    floor = 2 * least / (F.length("_q") + least) + bonus
    worst = best.groupBy("registry", "query").agg(F.when(F.count("*") == k, F.max("score")).alias("_worst"))
    rows = queries.join(worst, ["registry", "query"], "left").select(*queries.columns, "_worst")
    return rows.filter(F.col("_worst").isNull() | (F.col("_worst") >= floor))


def suggest_names(missing: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """The k best-scoring index names for each ``missing(registry, package_name)``; ``rank`` starts at 1."""
    ensure_checkpoint_dir(missing.sparkSession)
    # Every round and branch reads both; what they come from is worked out once.
    queries, names = _prepared(missing, "query", "q").checkpoint(), _prepared(index, "candidate", "c").checkpoint()
    if names.isEmpty() or queries.isEmpty():
        return top_k(score_pairs(queries.join(names, "registry")), k).withColumnRenamed("query", "package_name")
    seen = containment_pairs(queries, names).unionByName(plain_pairs(queries, names, 2))
    scoped = not (queries.filter("_q <> _ql").isEmpty() and names.filter("_c <> _cl").isEmpty())
    if scoped:
        seen = seen.unionByName(near_pairs(queries, names, "1", _SCOPED))
    best = top_k(score_pairs(seen), k).checkpoint()
    for least, limit in ((2, "2"), (3, PLAUSIBLE)) if scoped else ():
        wide = near_pairs(_open(queries, best, k, least, PREFIX_BONUS).checkpoint(), names, limit, _SCOPED)
        best = top_k(best.drop("rank").unionByName(score_pairs(wide)), k).checkpoint()
    wide = plain_pairs(_open(queries, best, k, 3, PREFIX_BONUS).checkpoint(), names)
    best = top_k(best.drop("rank").unionByName(score_pairs(wide)), k).checkpoint()
    return best.withColumnRenamed("query", "package_name")


def suggest_from(missing: DataFrame, catalogue: DataFrame, k: int = 3) -> DataFrame:
    """Top-k against a fixed catalogue (a constant of the library, so each name meets all of it)."""
    queries, names = _prepared(missing, "query", "q"), _prepared(catalogue, "candidate", "c")
    return top_k(score_pairs(queries.join(F.broadcast(names), "registry")), k).withColumnRenamed("query", "package_name")

"""Route handlers and the security controls they lack.

All grammars run in one scan of the corpus, whose matches are checkpointed; what follows works on them and never reads the
corpus again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import java_regex
from ..rules import endpoints as ep
from ..session import ensure_checkpoint_dir
from .spans import rule_spans, to_findings

_COLUMNS = ["file", "kind", "method", "path", "start", "end", "line", "column", "end_line", "end_column", "snippet"]


def endpoint_spans(corpus: DataFrame) -> DataFrame:
    """Matches of every endpoint grammar, named by ``what``; several branches use them, so they are cut off the scan here."""
    ensure_checkpoint_dir(corpus.sparkSession)
    matches = rule_spans(corpus, ep.ENDPOINT_RULES, groups=3).withColumn("what", F.col("rule.id")).drop("rule", "ordinal")
    return matches.checkpoint()


def _first(text: Column, *patterns: tuple[str, str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, java_regex(p, flags), 1), F.lit("")) for p, flags in patterns])


def _spring_path(arguments: Column) -> Column:
    named = (r"""\b(?:value|path)\s*=\s*["']([^"']+)["']""", "i")
    return F.coalesce(_first(arguments, named, (r"""["']([^"']+)["']""", "")), F.lit("/"))


def resolve_route_prefix(routes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Routes with the class prefix in front: the latest prefix that starts before the route in its file.

    An as-of join: prefixes and routes of a file are read in order and the last prefix carries forward.
    """
    both = routes.withColumn("_prefix", F.lit(None).cast("string")).withColumn("_is", F.lit(0)).unionByName(
        prefixes.select("file", "start", F.col("path").alias("_prefix"), F.lit(1).alias("_is")), allowMissingColumns=True
    )
    earlier = Window.partitionBy("file").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    prefix = F.coalesce(F.last("_prefix", True).over(earlier), F.lit(""))
    joined = (
        F.when(F.col("_p").isin("", "/"), F.coalesce(F.nullif("path", F.lit("")), F.lit("/")))
        .when(F.coalesce("path", F.lit("")).isin("", "/"), F.when(F.col("_p").startswith("/"), F.col("_p")).otherwise(F.concat(F.lit("/"), "_p")))
        .otherwise(F.regexp_replace(F.concat(F.lit("/"), "_p", F.lit("/"), "path"), "/+", "/"))
    )
    return both.withColumn("_p", prefix).filter("_is = 0").withColumn("path", joined).select(routes.columns)


def _django_method(snippet: Column) -> Column:
    listed = F.regexp_extract(snippet, java_regex(r"@require_http_methods\s*\(\s*\[([^\]]+)]", "i"), 1)
    return F.coalesce(
        F.lower(_first(snippet, (r"@require_(GET|POST|PUT|PATCH|DELETE)\b", "i"))),
        F.lower(_first(snippet, (r"""@api_view\s*\(\s*\[\s*["'](GET|POST|PUT|PATCH|DELETE)""", "i"))),
        F.lower(_first(listed, (r"""["'](GET|POST|PUT|PATCH|DELETE)""", "i"))),
        F.lit("request"),
    )


def extract_endpoints(spans: DataFrame) -> DataFrame:
    """Endpoints of all frameworks from ``endpoint_spans``."""
    snippet = F.col("match")
    place = ["file", "start", "end", "line", "column", "end_line", "end_column", snippet.alias("snippet")]
    of = lambda what: spans.filter(F.col("what") == what)
    row = lambda df, kind, method, path: df.select(
        *place, F.lit(kind).alias("kind"), method.alias("method"), path.alias("path")
    )
    script = row(of("js_route"), "javascript", F.lower("g1"), F.col("g2"))
    decorator = F.substring_index(snippet, "\n", 1)
    python = row(of("py_route"), "python", F.lower(F.regexp_extract(decorator, r"(?i)\.(route|get|post|put|patch|delete)\s*\(", 1)), F.col("g1"))
    method = F.coalesce(
        F.lower(F.nullif("g1", F.lit(""))),
        F.lower(_first(F.col("g2"), (r"RequestMethod\s*\.\s*(GET|POST|PUT|PATCH|DELETE)", "i"))),
        F.lit("request"),
    )
    spring = resolve_route_prefix(
        row(of("spring_route"), "java", method, _spring_path(F.col("g2"))),
        of("spring_prefix").select("file", "start", _spring_path(F.col("g1")).alias("path")),
    )
    # A view takes the path of its first route; without one it counts if it returns a framework response.
    gated = of("django_gate").select("file").distinct()
    views = row(of("django_view").withColumn("name", F.col("g1")), "python", _django_method(snippet), F.col("name"))
    views = views.join(gated, "file", "left_semi").withColumnRenamed("path", "name")
    last_of_name = Window.partitionBy("file", "name").orderBy(F.desc("start"))
    numbered = views.withColumn("_n", F.row_number().over(last_of_name))
    bare = F.regexp_replace(F.regexp_replace("g1", r"^\^", ""), r"\$\z", "")
    routes = of("django_route").select(
        "file", F.col("g2").alias("name"), "start", F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare)).alias("route")
    )
    first_route = routes.groupBy("file", "name").agg(F.min_by("route", "start").alias("route"))
    response = F.col("snippet").rlike(java_regex(ep.DJANGO_RESPONSE))
    own = F.concat(F.lit("/"), F.regexp_replace("name", "_", "-"))
    django = (
        numbered.join(first_route, ["file", "name"], "left")
        .withColumn("_routed", F.col("route").isNotNull() & (F.col("_n") == 1))
        .filter(F.col("_routed") | response)
        .withColumn("path", F.when(F.col("_routed"), F.col("route")).otherwise(own))
    )
    parts = [df.select(_COLUMNS) for df in (script, python, django, spring)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def middleware_controls(spans: DataFrame) -> DataFrame:
    """Path prefixes of a file that authentication or rate-limit middleware covers; empty means every route."""
    trimmed = F.regexp_replace(F.trim("g2"), r"/+\z", "")
    prefix = F.when(trimmed == "", "").when(trimmed.startswith("/"), trimmed).otherwise(F.concat(F.lit("/"), trimmed))
    rows = spans.filter("what = 'middleware'").select(
        "file",
        prefix.alias("prefix"),
        F.col("g3").rlike(java_regex(ep.AUTH_MIDDLEWARE, "i")).alias("auth"),
        F.col("g3").rlike(java_regex(ep.RATE_MIDDLEWARE, "i")).alias("rate"),
    )
    return rows.groupBy("file").agg(
        F.sort_array(F.collect_set(F.when(F.col("auth"), F.col("prefix")))).alias("auth_prefixes"),
        F.sort_array(F.collect_set(F.when(F.col("rate"), F.col("prefix")))).alias("rate_prefixes"),
    )


def control_coverage(endpoints: DataFrame, controls: DataFrame, now: int) -> DataFrame:
    """A finding for each of the six controls an endpoint should have and does not show."""
    low, snippet, path = F.lower("snippet"), F.col("snippet"), F.col("path")
    seen = lambda text, pattern, flags="": text.rlike(java_regex(pattern, flags))
    route = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    covered = lambda prefixes: F.coalesce(
        F.exists(prefixes, lambda p: (p == "") | (route == p) | route.startswith(F.concat(p, F.lit("/")))), F.lit(False)
    )
    user_input, database = seen(snippet, ep.USER_INPUT, "i"), seen(low, ep.DATABASE)
    bound = F.lit(False)
    for pattern, flags in ep.BOUND_QUERY:
        bound = bound | seen(low, pattern, flags)
    lacking = [
        seen(path, ep.SENSITIVE_PATH, "i") & ~seen(low, ep.HAS_AUTH) & ~covered(F.col("auth_prefixes")),
        ((F.col("method") != "get") | seen(path, ep.ABUSED_PATH, "i")) & ~seen(low, ep.HAS_RATE_LIMIT) & ~covered(F.col("rate_prefixes")),
        user_input & ~seen(low, ep.HAS_VALIDATION),
        user_input & database & seen(low, ep.DYNAMIC_SQL) & ~bound,
        (database | seen(low, ep.IO_CALL)) & ~seen(low, ep.HAS_ERROR_HANDLING),
        seen(snippet, ep.HTML_RESULT, "i") & ~seen(low, ep.HAS_ENCODING),
    ]
    subject = F.concat(F.lit("Endpoint "), F.upper("method"), F.lit(" "), path, F.lit(" "))
    rules = F.array_compact(
        F.array(
            *[
                F.when(
                    missing,
                    F.struct(
                        F.lit(i).alias("ordinal"), F.lit(id).alias("id"), F.lit(severity).alias("severity"),
                        F.lit("missing_security_measure").alias("type"), F.concat(subject, F.lit(message)).alias("message"),
                        F.lit(suggestion).alias("suggestion"), F.lit("L3").alias("layer"),
                    ),
                )
                for i, (missing, (id, severity, message, suggestion)) in enumerate(zip(lacking, ep.CONTROL_CHECKS))
            ]
        )
    )
    rows = endpoints.join(controls, "file", "left").withColumn("rule", F.explode(rules)).withColumn("match", F.col("snippet"))
    return to_findings(rows, now, detector=5)


def scan_endpoints(corpus: DataFrame, now: int) -> DataFrame:
    spans = endpoint_spans(corpus)
    return control_coverage(extract_endpoints(spans), middleware_controls(spans), now)


def review_targets(endpoints: DataFrame, limit: int = 6) -> DataFrame:
    """First handlers of each file by position, one per span, with the function that holds them."""
    unique = endpoints.dropDuplicates(["file", "start", "end"])
    ranked = unique.withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("start", "end")))
    name = _first(F.col("snippet"), *[(p, "") for p in ep.FUNCTION_NAMES])
    return ranked.filter(F.col("position") <= limit).select(
        "file", "position", name.alias("function_name"), F.concat(F.upper("method"), F.lit(" "), "path").alias("route"),
        F.col("line").alias("start_line"), F.col("snippet").alias("code"),
    )


def detect_framework(corpus: DataFrame) -> DataFrame:
    text = F.col("text")
    found = F.when((F.col("language") == "typescriptreact") | text.rlike(ep.REACT_ELEMENT), "React").otherwise("Unknown")
    for name, pattern, flags in reversed(ep.FRAMEWORKS):
        found = F.when(text.rlike(java_regex(pattern, flags)), name).otherwise(found)
    return corpus.withColumn("framework", found)

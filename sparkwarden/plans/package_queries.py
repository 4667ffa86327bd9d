"""Package index, verification and similarity over word tables; registry responses rebuilt from table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import names as nm
from ..operators import index as ix
from ..operators import packages as pk
from ..operators import similarity as sim
from ..rules.seeds import INVENTED_PACKAGES, KNOWN_PACKAGES
from ..sources import registries as rg
from .registry import query

NOW = 1_710_000_000_000

IDX = """idx AS (SELECT DISTINCT 'npm' AS registry, unnest(regexp_extract_all(lower(text), '\\p{L}{4,}')) AS package_name
  FROM documents)"""
REFS = """refs AS (SELECT DISTINCT 'npm' AS registry, w AS package_name FROM (
  SELECT unnest(regexp_extract_all(lower(text), '\\p{L}{4,}')) AS w FROM benchmark
  UNION ALL SELECT unnest(regexp_extract_all(lower(text), '\\p{L}{4,}')) FROM conversations))"""


def words(df, column="text"):
    """Occurrences of lower-case words of four letters and more."""
    return df.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit("\\p{L}{4,}"), F.lit(0))).alias("package_name"))


def word_index(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return words(docs).distinct().select(F.lit("npm").alias("registry"), "package_name")


def word_references(spark, sf):
    both = words(fx.table(spark, sf, "benchmark")).unionByName(words(fx.table(spark, sf, "conversations")))
    return both.select(F.lit("npm").alias("registry"), "package_name", F.lit(None).cast("string").alias("lookup"))


@query(
    "normalize_names",
    """WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS raw FROM benchmark)
    SELECT raw, replace(lower(trim(raw)), '_', '-') AS index_key, replace(lower(trim('My_' || raw)), '_', '-') AS cargo_seed_key,
      lower(trim('My_' || raw)) AS npm_seed_key FROM w""",
)
def _(spark, sf):
    raw = fx.table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("raw")).distinct()
    prefixed = F.concat(F.lit("My_"), "raw")
    return raw.select(
        "raw",
        nm.index_key(F.col("raw")).alias("index_key"),
        nm.seed_key(F.lit("cargo"), prefixed).alias("cargo_seed_key"),
        nm.seed_key(F.lit("npm"), prefixed).alias("npm_seed_key"),
    )


BUILTINS = ", ".join(f"'{x}'" for x in nm.NODE_BUILTINS)


@query(
    "normalize_specifiers",
    f"""WITH e AS (SELECT DISTINCT event_type, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
    s AS (SELECT CASE k % 6 WHEN 0 THEN './' || event_type WHEN 1 THEN '@s' || user_id || '/' || event_type || '/deep' WHEN 2 THEN '!!' || event_type || '/x'
      WHEN 3 THEN 'node:fs' WHEN 4 THEN ['fs', 'path', 'lodash'][user_id % 3 + 1] ELSE event_type || '/sub/' || k END AS spec,
      CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN '@s' || user_id || '/' || event_type WHEN 2 THEN event_type WHEN 3 THEN NULL
        WHEN 4 THEN CASE WHEN user_id % 3 = 2 THEN 'lodash' END ELSE event_type END AS name,
      'github.com/o' || user_id || '/' || event_type || '/v2/pkg' AS go_spec, 'github.com/o' || user_id || '/' || event_type AS go_root FROM e)
    SELECT DISTINCT spec, name, go_spec, go_root FROM s""",
)
def _(spark, sf):
    e = fx.events(spark, sf).select("event_type", "user_id", "k").distinct()
    kind, user, k = F.col("event_type"), F.col("user_id").cast("string"), F.col("k") % 6
    spec = (
        F.when(k == 0, F.concat(F.lit("./"), kind))
        .when(k == 1, F.concat(F.lit("@s"), user, F.lit("/"), kind, F.lit("/deep")))
        .when(k == 2, F.concat(F.lit("!!"), kind, F.lit("/x")))
        .when(k == 3, F.lit("node:fs"))
        .when(k == 4, fx._pick(F.col("user_id") % 3, (0, "fs"), (1, "path"), (2, "lodash")))
        .otherwise(F.concat(kind, F.lit("/sub/"), F.col("k").cast("string")))
    )
    go = F.concat(F.lit("github.com/o"), user, F.lit("/"), kind, F.lit("/v2/pkg"))
    return e.select(spec.alias("spec"), nm.npm_package(spec).alias("name"), go.alias("go_spec"), nm.go_module(go, True).alias("go_root")).distinct()


CACHE = f"""cache AS (SELECT 'npm' AS registry, package_name, length(package_name) % 2 = 0 AS "exists",
  CASE WHEN package_name < 'm' THEN {NOW} - 1000 ELSE {NOW} - 100000000 END AS last_verified FROM refs WHERE package_name LIKE '%e%')"""


def resolution_cache(references):
    return references.filter(F.contains("package_name", F.lit("e"))).select("registry", "package_name").distinct().select(
        "registry",
        "package_name",
        (F.length("package_name") % 2 == 0).alias("exists"),
        F.when(F.col("package_name") < "m", NOW - 1000).otherwise(NOW - 100_000_000).alias("last_verified"),
    )


def coverage(spark, kind):
    return spark.createDataFrame([("npm", kind, NOW - 5000)], "registry string, coverage string, updated_at bigint")


KNOWN_NPM = ", ".join(f"'{n}'" for n in KNOWN_PACKAGES["npm"])


@query(
    "verify_full_index",
    f"""WITH {IDX}, {REFS} SELECT registry, package_name, package_name IN (SELECT package_name FROM idx) AS "exists", 'index' AS source FROM refs""",
)
def verify_full(spark, sf):
    refs = word_references(spark, sf)
    out = pk.verify(refs, word_index(spark, sf), coverage(spark, "full"), resolution_cache(refs), NOW)
    return out.select("registry", "package_name", "exists", "source")


@query(
    "verify_partial_index",
    f"""WITH {IDX}, {REFS}, {CACHE} SELECT r.registry, r.package_name,
      CASE WHEN i.package_name IS NOT NULL THEN TRUE WHEN r.package_name IN ({KNOWN_NPM}) THEN TRUE
        WHEN {NOW} - c.last_verified < 86400000 THEN c."exists" END AS "exists",
      CASE WHEN i.package_name IS NOT NULL THEN 'index' WHEN r.package_name IN ({KNOWN_NPM}) THEN 'seed'
        WHEN {NOW} - c.last_verified < 86400000 THEN 'cache' ELSE 'unverified' END AS source
    FROM refs r LEFT JOIN idx i USING (package_name) LEFT JOIN cache c ON c.package_name = r.package_name""",
)
def _(spark, sf):
    refs = word_references(spark, sf)
    out = pk.verify(refs, word_index(spark, sf), coverage(spark, "partial"), resolution_cache(refs), NOW)
    return out.select("registry", "package_name", "exists", "source")


@query(
    "missing_packages",
    f"""WITH {IDX}, o AS (SELECT 'b' || item_id AS file, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{4,}}')) AS w FROM benchmark
      UNION ALL SELECT 'c' || conv_id || '_' || turn, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{4,}}')) FROM conversations),
    m AS (SELECT file, w, count(*) AS n FROM o WHERE w NOT IN (SELECT package_name FROM idx) GROUP BY ALL)
    SELECT file, w AS evidence, n, 'hallucinated_package_npm' AS detection_rule, 'critical' AS severity,
      '"' || w || '" does not exist in npm.' AS message FROM m""",
)
def missing(spark, sf):
    def refs(df, file):
        w = df.select(file.alias("file"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}{4,}"), F.lit(0))).alias("line", "package_name"))
        return w.select(
            "file", F.lit("npm").alias("registry"), "package_name", F.lit(None).cast("string").alias("lookup"),
            F.col("package_name").alias("raw_specifier"), (F.col("line") + 1).alias("line"), F.lit(1).alias("column"),
            (F.col("line") + 1).alias("end_line"), (F.length("package_name") + 1).alias("end_column"), F.lit("import").alias("source"),
        )

    b = refs(fx.table(spark, sf, "benchmark"), F.concat(F.lit("b"), F.col("item_id").cast("string")))
    c = refs(fx.table(spark, sf, "conversations"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")))
    references = b.unionByName(c)
    empty = spark.createDataFrame([], "registry string, package_name string, exists boolean, last_verified bigint")
    resolved = pk.verify(references, word_index(spark, sf), coverage(spark, "full"), empty, NOW)
    none = spark.createDataFrame([], "registry string, package_name string, similar array<string>")
    found = pk.missing_packages(references, resolved, none, NOW)
    return found.groupBy("file", "evidence", "detection_rule", "severity", "message").agg(F.count("*").alias("n"))


SEED_VALUES = ", ".join(f"('{n}')" for n in KNOWN_PACKAGES["npm"])


@query(
    "suggest_from_seed",
    f"""WITH {REFS}, s(candidate) AS (VALUES {SEED_VALUES}), p AS (
      SELECT package_name AS q, candidate, lower(candidate) AS c, list_last(list_filter(string_split_regex(lower(candidate), '[/:]'), lambda x: x <> '')) AS cl FROM refs, s),
    b AS (SELECT *, regexp_replace(q, '[^\x00-\x7F]', '~', 'g') AS qb FROM p),  -- levenshtein counts bytes here; no candidate holds a tilde
    d AS (SELECT *, levenshtein(qb, c) AS fd, least(levenshtein(qb, c), levenshtein(qb, cl)) AS distance,
      greatest(length(q), length(cl)) AS ml, greatest(length(q), length(c)) AS mf,
      contains(c, q) OR contains(q, c) OR contains(cl, q) OR contains(q, cl) AS inside FROM b WHERE q <> c),
    t AS (SELECT *, CAST(distance AS DOUBLE) / ml + CAST(fd AS DOUBLE) / mf + CASE WHEN inside THEN CAST(-0.35 AS DOUBLE) ELSE 0 END
      + CASE WHEN starts_with(c, left(q, 3)) OR starts_with(cl, left(q, 3)) THEN CAST(-0.15 AS DOUBLE) ELSE 0 END AS score
      FROM d WHERE distance <= greatest(2, floor(ml * 0.35)) OR fd <= greatest(3, floor(mf * 0.28)) OR inside)
    SELECT q AS package_name, candidate, distance, round(score, 9) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY q ORDER BY score, distance, candidate) AS rank FROM t) WHERE rank <= 3""",
)
def _(spark, sf):
    seed = pk.seed_table(spark).filter("exists")
    out = sim.suggest_from(word_references(spark, sf), seed, 3)
    return out.select("package_name", "candidate", F.col("distance").cast("bigint").alias("distance"), F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def missing_words(spark, sf):
    return word_references(spark, sf).join(word_index(spark, sf), ["registry", "package_name"], "left_anti").select("registry", "package_name").distinct()


@query("suggest_names")
def suggest(spark, sf):
    return sim.suggest_names(missing_words(spark, sf), word_index(spark, sf), 5)


@query(
    "import_index",
    f"""WITH {IDX}, {REFS} SELECT * FROM (SELECT 'pypi' AS registry, package_name FROM idx UNION SELECT registry, package_name FROM refs)""",
)
def _(spark, sf):
    idx = word_index(spark, sf)
    both = idx.unionByName(idx.withColumn("registry", F.lit("pypi")))
    names = word_references(spark, sf).withColumn("package_name", F.translate("package_name", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return ix.import_index(both, names, "full")


@query(
    "import_index_partial",
    f"WITH {IDX}, {REFS} SELECT registry, package_name FROM idx UNION SELECT registry, package_name || '-x' FROM refs",
)
def _(spark, sf):
    names = word_references(spark, sf).withColumn("package_name", F.concat("package_name", F.lit("_X ")))
    return ix.import_index(word_index(spark, sf), names, "partial")


@query(
    "apply_changes",
    """WITH last_ AS (SELECT user_id, arg_max(event_type, event_id) AS what FROM events GROUP BY user_id),
    idx AS (SELECT DISTINCT 'pkg-' || user_id AS package_name FROM events WHERE user_id % 3 = 0)
    SELECT 'npm' AS registry, package_name FROM idx WHERE package_name NOT IN (SELECT 'pkg-' || user_id FROM last_)
    UNION SELECT 'npm', 'pkg-' || user_id FROM last_ WHERE what <> 'error'""",
)
def _(spark, sf):
    e = fx.events(spark, sf)
    name = F.concat(F.lit("Pkg_"), F.col("user_id").cast("string"))
    index = e.filter("user_id % 3 = 0").select(F.lit("npm").alias("registry"), nm.index_key(name).alias("package_name")).distinct()
    changes = e.select(F.lit("npm").alias("registry"), name.alias("package_name"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("seq"))
    return ix.apply_changes(index, changes)


@query(
    "upsert_resolutions",
    """WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events), n AS (
      SELECT 'npm' AS registry, 'pkg-' || user_id AS package_name, value > 200 AS "exists", event_type AS source, ms AS last_verified, event_type <> 'view' AS fresh FROM e WHERE event_type <> 'signup'),
    b AS (SELECT *, row_number() OVER (PARTITION BY package_name ORDER BY fresh DESC, last_verified DESC, "exists" DESC, source DESC) AS rn FROM n)
    SELECT registry, package_name, "exists", source, last_verified FROM b WHERE rn = 1""",
)
def _(spark, sf):
    e = fx.events(spark, sf)
    row = lambda df, name: df.select(
        F.lit("npm").alias("registry"), name.alias("package_name"),
        F.when(F.col("event_type") != "signup", F.col("value") > 200).alias("exists"),
        F.col("event_type").alias("source"), F.col("ms").alias("last_verified"),
    )
    user = F.col("user_id").cast("string")
    stored = row(e.filter("event_type = 'view'"), F.concat(F.lit("pkg-"), user))
    stored = stored.groupBy("registry", "package_name").agg(F.max(F.struct("last_verified", "exists", "source")).alias("r")).select(
        "registry", "package_name", "r.exists", "r.source", "r.last_verified"
    )
    return ix.upsert_resolutions(stored, row(e.filter("event_type <> 'view'"), F.concat(F.lit("Pkg_"), user)))


@query(
    "index_stats",
    f"""WITH {IDX}, r(registry, coverage, updated_at) AS (VALUES ('npm', 'full', {NOW}::BIGINT), ('pypi', 'partial', {NOW}::BIGINT), ('cargo', 'partial', {NOW}::BIGINT)),
    p AS (SELECT registry, package_name FROM idx UNION ALL SELECT 'pypi', package_name FROM idx WHERE package_name < 'f')
    SELECT r.registry, coverage, updated_at, count(package_name) AS package_count FROM r LEFT JOIN p USING (registry) GROUP BY ALL""",
)
def index_stats(spark, sf):
    idx = word_index(spark, sf)
    packages = idx.unionByName(idx.filter("package_name < 'f'").withColumn("registry", F.lit("pypi")))
    rows = [("npm", "full", NOW), ("pypi", "partial", NOW), ("cargo", "partial", NOW)]
    return ix.index_stats(spark.createDataFrame(rows, "registry string, coverage string, updated_at bigint"), packages)


@query(
    "sync_plan",
    """WITH s AS (SELECT CASE event_type WHEN 'error' THEN 'npm' WHEN 'click' THEN 'pypi' WHEN 'view' THEN 'cargo' ELSE 'gomod' END AS registry,
      max(epoch_us(ts) // 1000) AS updated_at FROM events WHERE event_type <> 'signup' GROUP BY 1),
    w(position, registry) AS (VALUES (0, 'cargo'), (1, 'npm'), (2, 'pypi'), (3, 'maven')),
    t AS (SELECT w.position, w.registry, CASE WHEN updated_at IS NULL THEN 'missing' WHEN w.registry = 'npm' THEN
       CASE WHEN greatest(0, 1706745600000 - updated_at) >= 604800000 THEN 'stale' ELSE 'fresh' END ELSE
       CASE WHEN greatest(0, 1706745600000 - updated_at) >= 604800000 THEN 'stale' ELSE 'fresh' END END AS reason,
       greatest(0, 1706745600000 - updated_at) AS age_ms FROM w LEFT JOIN s USING (registry))
    SELECT position, registry, reason, reason <> 'fresh' AS due, CASE WHEN reason <> 'missing' THEN age_ms END AS age_ms, 'partial' AS requested_coverage,
      CASE WHEN registry = 'cargo' THEN 100 ELSE 100000 END::BIGINT AS name_limit FROM t""",
)
def _(spark, sf):
    e = fx.events(spark, sf).filter("event_type <> 'signup'")
    registry = fx._pick(F.col("event_type"), ("error", "npm"), ("click", "pypi"), ("view", "cargo"), ("purchase", "gomod"))
    stats = e.groupBy(registry.alias("registry")).agg(F.max("ms").alias("updated_at"), F.count("*").alias("package_count")).withColumn("coverage", F.lit("partial"))
    return ix.sync_plan(stats, ["npm", "cargo", "pypi", "maven", "npm"], 1_706_745_600_000, interval="weekly", detected=["cargo"])


ANCHORS = """a AS (SELECT page_id AS page, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1)) AS raw,
  unnest(range(len(regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1)))) AS position FROM pages),
names AS (SELECT page, position, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'),
  '&quot;', '"'), '&#39;', ''''), '(?i)&#x2F;', '/', 'g')) AS name FROM a)"""


def html_pages(spark, sf):
    return fx.table(spark, sf, "pages").select(F.lit("pypi").alias("registry"), F.col("page_id").alias("page"), F.col("html").alias("body"))


@query("names_from_anchor_html", f"WITH {ANCHORS} SELECT 'pypi' AS registry, page, CAST(position AS INT) AS position, name FROM names WHERE name <> ''")
def _(spark, sf):
    return rg.names_from_anchor_html(html_pages(spark, sf)).drop("total")


@query(
    "dedupe_names",
    f"""WITH {ANCHORS}, u AS (SELECT *, replace(lower(name), '_', '-') AS key, row_number() OVER (PARTITION BY replace(lower(name), '_', '-') ORDER BY page, position) AS rn FROM names WHERE name <> '')
    SELECT name, key, page, CAST(position AS INT) AS position, (SELECT count(*) FROM u WHERE rn = 1) > 150 AS truncated FROM u WHERE rn = 1 ORDER BY page, position LIMIT 150""",
)
def _(spark, sf):
    return ix.dedupe_names(rg.names_from_anchor_html(html_pages(spark, sf)), limit=150)


# Registry responses rebuilt from event rows, one response per user; the twin reads the rows directly.
def responses(spark, sf, registry, row, wrap):
    e = fx.events(spark, sf).select("event_id", "user_id", "event_type", "k")
    grouped = e.groupBy(F.col("user_id").alias("page")).agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "k", "user_id"))).alias("es"))
    return grouped.select(F.lit(registry).alias("registry"), "page", wrap(F.transform("es", row)).alias("body"))


NUMBERED = "n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def pkg(e):
    return F.concat(e["event_type"], F.lit("-"), e["k"].cast("string"))


@query(
    "names_from_npm_docs",
    f"""WITH {NUMBERED} SELECT 'npm' AS registry, user_id AS page, CAST(pos AS INT) AS position, event_type || '-' || k AS name, 5000::BIGINT AS total FROM n WHERE event_type <> 'view' """,
)
def _(spark, sf):
    row = lambda e: F.struct(
        F.when(e["k"] % 2 == 0, F.concat(F.when(e["event_type"] == "view", "_design/").otherwise(""), pkg(e))).alias("id"),
        F.concat(F.when(e["event_type"] == "view", "_design/").otherwise(""), pkg(e)).alias("key"),
    )
    wrap = lambda rows: F.to_json(F.struct(F.lit(5000).alias("total_rows"), rows.alias("rows")))
    return rg.names_from_npm_docs(responses(spark, sf, "npm", row, wrap))


@query(
    "names_from_crates",
    f"WITH {NUMBERED} SELECT 'cargo' AS registry, user_id AS page, CAST(pos AS INT) AS position, event_type || '-' || k AS name, user_id AS total FROM n WHERE k % 3 <> 2",
)
def _(spark, sf):
    row = lambda e: F.struct(F.when(e["k"] % 3 == 0, pkg(e)).otherwise(" ").alias("id"), F.when(e["k"] % 3 == 1, pkg(e)).alias("name"))
    pages = responses(spark, sf, "cargo", row, lambda rows: F.to_json(F.struct(rows.alias("crates"))))
    meta = F.concat(F.lit(',"meta":{"total":'), F.col("page").cast("string"), F.lit("}}"))
    return rg.names_from_crates(pages.withColumn("body", F.concat(F.regexp_replace("body", "}\\z", ""), meta)))


@query(
    "names_from_module_index",
    f"WITH {NUMBERED} SELECT 'gomod' AS registry, user_id AS page, CAST(pos AS INT) AS position, event_type || '-' || k AS name FROM n WHERE k % 4 <> 0",
)
def _(spark, sf):
    row = lambda e: F.when(e["k"] % 4 == 0, F.lit('{"Path": broken')).otherwise(F.concat(F.lit('{"Path":"'), pkg(e), F.lit('","Version":"v1"}')))
    return rg.names_from_module_index(responses(spark, sf, "gomod", row, lambda rows: F.array_join(rows, "\n"))).drop("total")


@query(
    "names_from_maven_search",
    f"""WITH {NUMBERED} SELECT 'maven' AS registry, user_id AS page, CAST(pos AS INT) AS position,
      CASE k % 3 WHEN 0 THEN 'org.' || event_type || ':' || event_type || '-' || k ELSE 'id:' || event_type || '-' || k END AS name, 7::BIGINT AS total FROM n WHERE k % 3 <> 2""",
)
def _(spark, sf):
    row = lambda e: F.struct(
        F.when(e["k"] % 3 == 0, F.concat(F.lit("org."), e["event_type"])).alias("g"),
        pkg(e).alias("a"),
        F.when(e["k"] % 3 == 1, F.concat(F.lit("id:"), pkg(e))).otherwise(pkg(e)).alias("id"),
    )
    wrap = lambda rows: F.to_json(F.struct(F.struct(F.lit(7).alias("numFound"), rows.alias("docs")).alias("response")))
    return rg.names_from_maven_search(responses(spark, sf, "maven", row, wrap))


@query(
    "read_package_list",
    f"""WITH {NUMBERED} SELECT user_id AS page, CAST(pos AS INT) AS position, event_type || '-' || k AS name,
      ['json-array', 'json-rows', 'json-packages', 'line-list'][user_id % 4 + 1] AS format FROM n WHERE user_id % 4 <> 3 OR k % 5 <> 0""",
)
def _(spark, sf):
    kind = F.col("page") % 4
    base = responses(spark, sf, "npm", lambda e: pkg(e), lambda rows: rows)
    line = lambda n: F.when(F.element_at(F.split(n, "-"), -1).cast("int") % 5 == 0, F.concat(F.lit("# "), n)).otherwise(F.concat(F.lit('"'), n, F.lit('"  # kept')))
    # The closing quote is followed by a comment, which is cut first.
    body = (
        F.when(kind == 0, F.to_json("body"))
        .when(kind == 1, F.to_json(F.struct(F.transform("body", lambda n: F.struct(n.alias("id"))).alias("rows"))))
        .when(kind == 2, F.to_json(F.struct(F.col("body").alias("packages"))))
        .otherwise(F.array_join(F.transform("body", line), "\r\n"))
    )
    return rg.read_package_list(base.withColumn("body", body)).select("page", "position", "name", "format")


@query(
    "npm_changes",
    f"""WITH {NUMBERED}, last_ AS (SELECT event_type || '-' || k AS name, arg_max(value < 100, user_id * 1000000 + pos) AS gone FROM n WHERE event_type <> 'view' GROUP BY 1)
    SELECT 'npm' AS registry, name AS package_name FROM last_ WHERE NOT gone UNION SELECT 'npm', 'kept'""",
)
def _(spark, sf):
    e = fx.events(spark, sf)
    grouped = e.groupBy(F.col("user_id").alias("page")).agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "k", "value"))).alias("es"))
    row = lambda x: F.struct(
        F.concat(F.when(x["event_type"] == "view", "_design/").otherwise(""), pkg(x)).alias("id"),
        F.when(x["value"] < 100, True).alias("deleted"),
    )
    feeds = grouped.select(
        F.lit("npm").alias("registry"), "page",
        F.to_json(F.struct(F.transform("es", row).alias("results"), F.lit("9-x").alias("last_seq"))).alias("body"),
    )
    index = spark.createDataFrame([("npm", "kept")], "registry string, package_name string")
    return ix.apply_changes(index, rg.npm_changes(feeds))


@query(
    "replacement_candidates",
    """WITH n AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN event_type ELSE event_type || '-' || user_id END AS original,
      [event_type, trim(' ' || event_type || '-' || user_id || ' '), 'two words', trim(event_type || ' '), '@scope/' || event_type,
       'bad\\name', repeat('x', 257), ''] AS listed FROM events)
    SELECT event_id, array_to_string(list_filter(listed, lambda x, i: list_position(listed, x) = i AND x <> original
      AND length(x) BETWEEN 1 AND 256 AND regexp_full_match(x, '[A-Za-z0-9@._/+:-]+')), ',') AS candidates FROM n""",
)
def _(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    listed = F.array(
        kind, F.concat(F.lit(" "), kind, F.lit("-"), user, F.lit(" ")), F.lit("two words"), F.concat(kind, F.lit(" ")),
        F.concat(F.lit("@scope/"), kind), F.lit("bad\\name"), F.repeat(F.lit("x"), 257), F.lit(""),
    )
    original = F.when(F.col("user_id") % 2 == 0, kind).otherwise(F.concat(kind, F.lit("-"), user))
    rows = fx.table(spark, sf, "events")
    return rows.select("event_id", F.array_join(pk.replacement_candidates(listed, original), ",").alias("candidates"))

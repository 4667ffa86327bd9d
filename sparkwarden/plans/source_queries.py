"""References, endpoints, reviews, taint and ingest over source files and payloads written from event rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import endpoints as en
from ..operators import references as rf
from ..operators import review as rv
from ..operators import taint as tt
from ..sources import ingest as ig
from .detection_queries import NOW, _sql
from .registry import query

# One file per event. {u} is the user (three digits), {k} a number (two digits), so columns stay where they are.
# (file name, text, expected references: registry, name, raw specifier, line, column).
FILES = [
    ("a{k}.ts", "// import no from 'nope{u}'\nimport React from \"react{u}\";\nconst y = require('lib{k}/fp');\nimport './local';\nconst s = \"import z from 'bad'\";\nimport('@s{u}/pkg/deep');\nimport fs from 'fs';\n",
     [("npm", "react{u}", "react{u}", 2, 20), ("npm", "lib{k}", "lib{k}/fp", 3, 20), ("npm", "@s{u}/pkg", "@s{u}/pkg/deep", 6, 9)]),
    ("b{k}.py", "import os, mod{u} as m, PIL.Image\n'''\nimport fake{u}\n'''\nfrom pkg{k}.sub import x\nos.system('pip install -r r.txt tool{u}==2')\n",
     [("pypi", "mod{u}", "mod{u}", 1, 12), ("pypi", "pillow", "PIL.Image", 1, 25), ("pypi", "pkg{k}", "pkg{k}.sub", 5, 6), ("pypi", "tool{u}", "tool{u}", 6, 33)]),
    ("ci{k}.yml", "steps:\n  - run: pip install --index-url http://x p{u} Black_{k}==22 # c\n# pip install nope\n",
     [("pypi", "p{u}", "p{u}", 2, 43), ("pypi", "black-{k}", "Black_{k}", 2, 48)]),
    ("x{k}/package.json", '{"dependencies": {"d{u}": "^1", "left": "file:../x"}, "devDependencies": {"v{k}":"1"}}',
     [("npm", "d{u}", "d{u}", 1, 19), ("npm", "v{k}", "v{k}", 1, 75)]),
    ("requirements/r{k}.txt", "Flask{u}[async]>=2 # c\n# no\n-r other\nnumpy{k}\n", [("pypi", "flask{u}", "Flask{u}", 1, 1), ("pypi", "numpy{k}", "numpy{k}", 4, 1)]),
    ("x{k}/pyproject.toml", '[project]\ndependencies = [\n "h{u}>=1", # c\n "rich[all]"\n]\n[tool.poetry.dependencies]\npython = "^3"\nd{k} = "1"\n[build-system]\nrequires = ["hatch{u}"]',
     [("pypi", "h{u}", "h{u}", 3, 3), ("pypi", "rich", "rich", 4, 3), ("pypi", "d{k}", "d{k}", 8, 1), ("pypi", "hatch{u}", "hatch{u}", 10, 14)]),
    ("x{k}/Cargo.toml", '[package]\nname = "a"\n[dependencies]\ns{u} = "1"\nlocal = { path = "../l" }\nren = { package = "real-{k}", version = "1" }\n[target.\'cfg(unix)\'.dependencies]\nn{u} = "1"',
     [("cargo", "s{u}", "s{u}", 4, 1), ("cargo", "real-{k}", "real-{k}", 6, 20), ("cargo", "n{u}", "n{u}", 8, 1)]),
    ("m{k}.rs", "use s{u}::de;\nuse std::io;\nextern crate r{k};\n", [("cargo", "s{u}", "s{u}", 1, 5), ("cargo", "r{k}", "r{k}", 3, 14)]),
    ("x{k}/go.mod", "module x\nrequire github.com/a/b{u} v1.2\nrequire (\n\tgithub.com/c/d{k} v1.0 // indirect\n)\n",
     [("gomod", "github.com/a/b{u}", "github.com/a/b{u}", 2, 9), ("gomod", "github.com/c/d{k}", "github.com/c/d{k}", 4, 2)]),
    ("m{k}.go", "import \"fmt\"\nimport (\n\tx \"github.com/a/b{u}/sub\"\n\t\"golang.org/x/crypto/ssh\"\n)\n",
     [("gomod", "github.com/a/b{u}", "github.com/a/b{u}/sub", 3, 5), ("gomod", "golang.org/x/crypto", "golang.org/x/crypto/ssh", 4, 3)]),
    ("x{k}/pom.xml", "<d><dependency>\n<groupId>org.x{u}</groupId>\n<artifactId>y{k}</artifactId></dependency></d>", [("maven", "org.x{u}:y{k}", "y{k}", 3, 13)]),
    ("x{k}/build.gradle", "implementation 'com.g{u}:guava:1'\n", [("maven", "com.g{u}:guava", "com.g{u}:guava", 1, 17)]),
    ("l{k}.versions.toml", '[libraries]\na = { module = "g.a{u}:b", version = "1" }\nb = { group = "g.c", name = "d{k}" }\nc = "g.e:f{k}:1"\n[plugins]\nz = "q.q:w:1"',
     [("maven", "g.a{u}:b", "g.a{u}:b", 2, 17), ("maven", "g.c:d{k}", "g.c:d{k}", 3, 1), ("maven", "g.e:f{k}", "g.e:f{k}", 4, 6)]),
    ("M{k}.java", "import java.util.List;\nimport com.f{u}.Bar;\nimport static com.q.R.x;\nimport lower.case;\n", [("maven", "com.f{u}.Bar", "com.f{u}.Bar", 2, 8)]),
]


def filled(template, row_user, row_k):
    return F.replace(F.replace(template, F.lit("{u}"), F.lpad(row_user.cast("string"), 3, "0")), F.lit("{k}"), F.lpad(row_k.cast("string"), 2, "0"))


def template_corpus(spark, sf, templates):
    e = fx.events(spark, sf)
    pick = lambda values: filled(F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values)).cast("int")), F.col("user_id"), F.col("k"))
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit("/"), pick([t[0] for t in templates])).alias("file"),
        pick([t[1] for t in templates]).alias("text"),
        F.lit(None).cast("string").alias("language"),
    )


def fill_sql(expr: str) -> str:
    return f"replace(replace({expr}, '{{u}}', lpad(CAST(user_id AS VARCHAR), 3, '0')), '{{k}}', lpad(CAST(k AS VARCHAR), 2, '0'))"


def expected_sql(rows, columns) -> str:
    """Expected rows per template, as VALUES joined with the events that use the template."""
    values = ", ".join("(" + ", ".join(_sql(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{fx.E_SQL}, x(template, {columns}) AS (VALUES {values})"


REF_SQL = f"""WITH {expected_sql([(i, f, *r) for i, (f, _, refs) in enumerate(FILES) for r in refs], 'fname, registry, package, raw, line, col')}
SELECT 'e' || event_id || '/' || {fill_sql('fname')} AS file, registry, {fill_sql('package')} AS package_name, {fill_sql('raw')} AS raw_specifier,
  CAST(line AS INT) AS line, CAST(col AS INT) AS "column" FROM e JOIN x ON event_id % {len(FILES)} = template"""
REF_COLUMNS = ["file", "registry", "package_name", "raw_specifier", "line", "column"]


@query("extract_references", REF_SQL)
def extract(spark, sf):
    return rf.extract_references(template_corpus(spark, sf, FILES)).select(REF_COLUMNS)


def _kind(name: str, numbers: list[int], fn) -> None:
    @query(name, f"{REF_SQL} WHERE template IN ({', '.join(map(str, numbers))})")
    def _(spark, sf):
        return fn(template_corpus(spark, sf, FILES)).select(REF_COLUMNS)


for _name, _numbers, _fn in [
    ("refs_javascript", [0], rf.refs_javascript), ("refs_python", [1], rf.refs_python), ("refs_pip_install", [2], rf.refs_pip_install),
    ("refs_package_json", [3], rf.refs_package_json), ("refs_requirements", [4], rf.refs_requirements),
    ("refs_pyproject", [5], lambda c: rf.refs_toml(c, ("pyproject",))), ("refs_cargo", [6], lambda c: rf.refs_toml(c, ("cargo",))),
    ("refs_rust", [7], rf.refs_rust), ("refs_go", [8, 9], lambda c: rf.refs_by_pattern(c, ["go", "gomod"])),
    ("refs_maven", [10, 11, 12], lambda c: rf.refs_by_pattern(c, ["pom", "gradle"]).unionByName(rf.refs_toml(c, ("catalog",)))),
    ("refs_jvm_imports", [13], rf.refs_jvm_imports),
]:
    _kind(_name, _numbers, _fn)

# (file name, text, framework, expected endpoints: kind, method, path, line, controls missing).
ROUTES = [
    ("a{k}.ts", "require('express');\napp.use('/admin', requireAuth, rateLimit());\napp.post('/admin/u{u}', (req, res) => {\n  db.query(`select * from u where id=${req.body.id}`);\n});\nrouter.get(\"/user/{k}\", async (req,res) => {\n  res.send(`<b>${req.query.q}</b>`);\n});\n", "Express",
     [("javascript", "post", "/admin/u{u}", 3, "error_handling,input_validation,parameterized_queries"), ("javascript", "get", "/user/{k}", 6, "authentication,input_validation,output_encoding")]),
    ("b{k}.py", "from flask import Flask\n@app.route('/login{u}', methods=['POST'])\ndef login():\n    x = request.form['a']\n    return open(x)\n", "Flask",
     [("python", "route", "/login{u}", 2, "error_handling,input_validation,rate_limiting")]),
    ("c{k}.py", "from django.urls import path\nurlpatterns=[path('user{u}/<id>', detail)]\n\n@require_POST\ndef detail(request, id):\n    return JsonResponse({})\n\ndef other_{k}(request):\n    return HttpResponse('x')\n\ndef helper(request):\n    pass\n", "Django",
     [("python", "post", "/user{u}/<id>", 4, "authentication,rate_limiting"), ("python", "request", "/other-{k}", 8, "rate_limiting")]),
    ("D{k}.java", "@RequestMapping(\"/api{u}\")\npublic class C {\n  @GetMapping(\"/users\")\n  public List<String> list(HttpServletRequest r) { return repository.find(1); }\n  @RequestMapping(value=\"x{k}\", method = RequestMethod.POST)\n  public void save(@RequestBody String b) { }\n}\n", "Spring",
     [("java", "get", "/api{u}/users", 3, "authentication,error_handling,input_validation"), ("java", "post", "/api{u}/x{k}", 5, "input_validation,rate_limiting")]),
    ("z{k}.txt", "nothing here {u}\n", "Unknown", []),
]
_ENDPOINTS = expected_sql([(i, f, *r) for i, (f, _, _, eps) in enumerate(ROUTES) for r in eps], "fname, kind, method, path, line, missing")
ENDPOINT_SQL = f"""WITH {_ENDPOINTS}, ep AS (SELECT 'e' || event_id || '/' || {fill_sql('fname')} AS file, kind, method, {fill_sql('path')} AS path,
  CAST(line AS INT) AS line, missing FROM e JOIN x ON event_id % {len(ROUTES)} = template)"""


def endpoint_spans(spark, sf):
    return en.endpoint_spans(template_corpus(spark, sf, ROUTES))


@query("extract_endpoints", f"{ENDPOINT_SQL} SELECT file, kind, method, path, line FROM ep")
def _(spark, sf):
    return en.extract_endpoints(endpoint_spans(spark, sf)).select("file", "kind", "method", "path", "line")


@query("control_coverage", f"{ENDPOINT_SQL} SELECT file, line, 'l3_missing_' || unnest(string_split(missing, ',')) AS detection_rule FROM ep")
def control_coverage(spark, sf):
    return en.scan_endpoints(template_corpus(spark, sf, ROUTES), NOW).select("file", "line", "detection_rule")


@query("middleware_controls", f"WITH {fx.E_SQL} SELECT 'e' || event_id || '/a' || lpad(CAST(k AS VARCHAR), 2, '0') || '.ts' AS file, '/admin' AS auth, '/admin' AS rate FROM e WHERE event_id % {len(ROUTES)} = 0")
def _(spark, sf):
    out = en.middleware_controls(endpoint_spans(spark, sf))
    return out.select("file", F.array_join("auth_prefixes", ",").alias("auth"), F.array_join("rate_prefixes", ",").alias("rate"))


@query("resolve_route_prefix", f"{ENDPOINT_SQL} SELECT file, path, line FROM ep WHERE kind = 'java'")
def _(spark, sf):
    return en.extract_endpoints(endpoint_spans(spark, sf)).filter("kind = 'java'").select("file", "path", "line")


@query("review_targets", f"""{ENDPOINT_SQL} SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY line) AS INT) AS position, upper(method) || ' ' || path AS route, line AS start_line FROM ep""")
def _(spark, sf):
    return en.review_targets(en.extract_endpoints(endpoint_spans(spark, sf))).select("file", "position", "route", "start_line")


_FW = expected_sql([(i, f, fw) for i, (f, _, fw, _) in enumerate(ROUTES)], "fname, framework")


@query("detect_framework", f"WITH {_FW} SELECT 'e' || event_id || '/' || {fill_sql('fname')} AS file, framework FROM e JOIN x ON event_id % {len(ROUTES)} = template")
def _(spark, sf):
    return en.detect_framework(template_corpus(spark, sf, ROUTES)).select("file", "framework")


# What a reviewer says about a file of each template: evidence to be found in the text, and a line to be quoted.
REVIEWS = [("db.query", 6), ("request.form", 5), ("JsonResponse", 9), ("repository.find", 6), ("here", 1)]
_BODIES = expected_sql([(i, f, body, *REVIEWS[i]) for i, (f, body, _, _) in enumerate(ROUTES)], "fname, body, evidence, quoted")


@query(
    "normalize_review_responses",
    f"""WITH {_BODIES}, t AS (SELECT 'e' || event_id || '/' || {fill_sql('fname')} AS file, {fill_sql('body')} AS text, evidence, quoted, user_id
      FROM e JOIN x ON event_id % {len(ROUTES)} = template),
    said AS (SELECT file, text, 'high' AS severity, 'm' || user_id AS message, evidence, 'l3_llm_sql_inj' AS detection_rule, 'safe()' AS new_text FROM t
      UNION ALL SELECT file, text, 'medium', 'n', trim(string_split(text, chr(10))[quoted]), 'l3_x', NULL FROM t),
    found AS (SELECT *, instr(text, evidence) AS place FROM said),
    cut AS (SELECT *, left(text, place - 1) AS head FROM found)
    SELECT file, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS INT) AS line, CAST(length(list_last(string_split(head, chr(10)))) + 1 AS INT) AS "column",
      severity, message, evidence, detection_rule, new_text FROM cut""",
)
def _(spark, sf):
    corpus = template_corpus(spark, sf, ROUTES)
    events = fx.events(spark, sf)
    of_template = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(ROUTES)).cast("int"))
    first = F.concat(
        F.lit('{"message":"m'), F.col("user_id").cast("string"), F.lit('","evidence":"'), of_template([e for e, _ in REVIEWS]),
        F.lit('","line":3,"severity":"high","ruleId":"SQL Inj!","replacement":"safe()"}'),
    )
    second = F.concat(F.lit(',{"message":"n","line":'), of_template([n for _, n in REVIEWS]).cast("string"), F.lit(',"severity":"urgent","rule_id":"L3_X"},{"evidence":"x"}]}'))
    items = F.concat(F.lit('{"findings":['), first, second)
    body = F.when(F.col("k") % 3 == 0, items).when(F.col("k") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), items, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), items, F.lit(" done")))
    file = F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit("/"), of_template([f for f, *_ in ROUTES]))
    answers = events.select(F.col("event_id").cast("string").alias("response_id"), body.alias("body"), filled(file, F.col("user_id"), F.col("k")).alias("file"))
    found = rv.normalize_review_responses(answers, corpus, NOW)
    new = F.col("fix.edits")[0]["newText"]
    return found.select("file", "line", "column", "severity", "message", "evidence", "detection_rule", new.alias("new_text"))


TAINT = """b AS (SELECT 'f' || user_id AS file, CAST(event_id AS VARCHAR) AS id, event_type || (k % 3) AS name, event_id AS start,
  CASE WHEN k % 10 = 0 THEN 'req.query.v' WHEN k % 10 < 3 THEN '''clean''' ELSE ['click', 'view', 'error', 'signup', 'purchase'][k % 5 + 1] || (k % 3) || ' + 1' END AS value,
  CASE WHEN k % 4 = 0 THEN (event_id // 1000) * 1000 ELSE 0 END AS scope_start, CASE WHEN k % 4 = 0 THEN (event_id // 1000) * 1000 + 1000 ELSE 1000000000 END AS scope_end FROM e),
edges AS (SELECT b.file, b.id, (SELECT v.id FROM b v WHERE v.file = b.file AND v.name = split_part(b.value, ' ', 1) AND v.start < b.start AND v.scope_start <= b.scope_start
  AND v.scope_end >= b.scope_end ORDER BY v.scope_end - v.scope_start, v.start DESC LIMIT 1) AS src FROM b WHERE b.value LIKE '% + 1'),
t AS (SELECT file, id FROM b WHERE value LIKE 'req.%' UNION SELECT x.file, x.id FROM edges x JOIN t ON x.file = t.file AND x.src = t.id)"""


@query("propagate_taint", f"WITH RECURSIVE {fx.E_SQL}, {TAINT} SELECT file, id FROM t")
def _(spark, sf):
    e = fx.events(spark, sf)
    k, n = F.col("k"), F.col("event_id")
    names = F.get(F.array(*[F.lit(x) for x in ("click", "view", "error", "signup", "purchase")]), k % 5)
    inner = k % 4 == 0
    block = (F.floor(n / 1000) * 1000).cast("bigint")
    b = e.select(
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), n.cast("string").alias("id"),
        F.concat("event_type", (k % 3).cast("string")).alias("name"),
        F.when(k % 10 == 0, "req.query.v").when(k % 10 < 3, "'clean'").otherwise(F.concat(names, (k % 3).cast("string"), F.lit(" + 1"))).alias("value"),
        n.alias("start"), F.when(inner, block).otherwise(F.lit(0)).alias("scope_start"), F.when(inner, block + 1000).otherwise(F.lit(1_000_000_000)).alias("scope_end"),
    )
    return tt.propagate_taint(b).select("file", "id")


def payloads(spark, sf):
    """One scan payload per user and event type; some are wrong in one way."""
    e = fx.events(spark, sf)
    finding = F.struct(
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("id"), fx._pick(F.col("event_type"), *fx.TYPE).alias("type"),
        F.when((F.col("user_id") % 7 == 1), "urgent").otherwise("high").alias("severity"), F.lit("m").alias("message"), F.lit("a.py").alias("file"),
        (F.col("k") + F.when(F.col("user_id") % 7 == 2, -F.col("k")).otherwise(1)).alias("line"), F.lit(1).alias("column"), F.lit("x").alias("evidence"),
        F.lit("L1").alias("detection_layer"), F.lit("r").alias("detection_rule"), F.col("ms").alias("timestamp"), (F.col("value") < 100).alias("dismissed"),
    )
    grouped = e.groupBy("user_id", "event_type").agg(F.collect_list(finding).alias("findings"), F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.min("event_id").alias("first"))
    bad = lambda n: F.col("user_id") % 7 == n
    id = F.concat_ws("_", "event_type", F.col("user_id").cast("string"))
    scan = F.struct(
        id.alias("scanId"), F.when(bad(3), F.col("hi") + 1).otherwise(F.col("lo")).alias("startedAt"), F.col("hi").alias("completedAt"),
        F.lit("p1").alias("project"), F.lit("/w").alias("cwd"), F.array(F.lit("src")).alias("targetPaths"), F.lit(1).alias("fileCount"), "findings",
        F.create_map(F.when(bad(4), "nobody").otherwise(F.concat(F.lit("f"), F.col("first").cast("string"))), F.struct(F.lit("Ada").alias("name"))).alias("findingAuthors"),
    )
    tag = F.when(bad(5), "other").otherwise(ig.SCHEMA_TAG)
    return grouped.select(id.alias("payload_id"), F.when(bad(6), F.lit("{broken")).otherwise(F.to_json(F.struct(tag.alias("schema"), scan.alias("scan")))).alias("body"))


@query(
    "read_ingest",
    """SELECT event_type || '_' || user_id AS scan_id, count(*) AS findings, count(*) FILTER (value < 100) AS dismissed, 1::BIGINT AS authored, min(epoch_us(ts) // 1000) AS started_at
    FROM events WHERE user_id % 7 = 0 GROUP BY 1""",
)
def _(spark, sf):
    runs, findings, _ = ig.read_ingest(payloads(spark, sf))
    counts = findings.groupBy("scan_id").agg(F.count("*").alias("findings"), F.count_if("dismissed").alias("dismissed"), F.count("author_name").alias("authored"))
    return runs.join(counts, "scan_id").select("scan_id", "findings", "dismissed", "authored", "started_at")


@query(
    "rejected_payloads",
    """SELECT CASE user_id % 7 WHEN 1 THEN 'invalid_findings' WHEN 2 THEN 'invalid_findings' WHEN 3 THEN 'invalid_completed_at' WHEN 4 THEN 'unknown_author_finding'
      WHEN 5 THEN 'unsupported_schema' ELSE 'invalid_json' END AS error, count(DISTINCT event_type || user_id) AS n FROM events WHERE user_id % 7 <> 0 GROUP BY 1""",
)
def _(spark, sf):
    rejected = ig.read_ingest(payloads(spark, sf))[2]
    return rejected.groupBy(F.col("errors")[0].alias("error")).agg(F.count("*").alias("n"))

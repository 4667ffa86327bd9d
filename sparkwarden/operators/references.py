"""Dependency references of manifests and source files.

Every kind of file has one pattern. All kinds but the section-based manifests go through a single scan: the pattern is
chosen per row, and an expression turns each match into the references it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as nm
from ..functions import text as tx
from ..rules import references as pat
from ..schema import REFERENCE_COLUMNS
from .spans import group_count, regex_spans, with_positions

_REF = "array<struct<registry:string,name:string,raw:string,off:int,source:string,lookup:string>>"


def file_kind(file: Column, language: Column) -> Column:
    """How a file is read: by manifest name first, then by extension or language; null when it names no packages."""
    path = F.regexp_replace(file, r"\\", "/")
    name, ext, lang = F.lower(tx.basename(file)), tx.extension(file), F.coalesce(language, F.lit(""))
    requirements = name.rlike(r"^requirements(?:[-_.][a-z0-9][a-z0-9_.-]*)?\.txt\z") | path.rlike(r"(?i)(?:^|/)requirements/[^/]+\.txt\z")
    return (
        F.when(name == "package.json", "package_json")
        .when(requirements, "requirements")
        .when(name == "pyproject.toml", "pyproject")
        .when(name == "cargo.toml", "cargo")
        .when(name == "go.mod", "gomod")
        .when(name == "pom.xml", "pom")
        .when(name.isin("build.gradle", "build.gradle.kts"), "gradle")
        .when(name.endswith(".versions.toml"), "catalog")
        .when(ext.isin("java", "kt", "kts") | lang.isin("java", "kotlin"), "jvm")
        .when(
            ext.isin("sh", "bash", "zsh", "ps1", "yml", "yaml") | (name == "dockerfile")
            | lang.isin("shellscript", "powershell", "yaml", "dockerfile"),
            "pip",
        )
        .when(
            ext.isin("js", "jsx", "ts", "tsx", "mjs", "cjs")
            | lang.isin("javascript", "typescript", "javascriptreact", "typescriptreact"),
            "javascript",
        )
        .when((ext == "py") | (lang == "python"), "python")
        .when((ext == "rs") | (lang == "rust"), "rust")
        .when((ext == "go") | (lang == "go"), "go")
    )


def _ref(registry: str, name: Column, raw: Column, off: Column, source: str, lookup: str | None = None) -> Column:
    return F.struct(
        F.lit(registry).alias("registry"), name.alias("name"), raw.alias("raw"), off.cast("int").alias("off"),
        F.lit(source).alias("source"), F.lit(lookup).cast("string").alias("lookup"),
    )


def _within(part: Column, whole: Column) -> Column:
    """0-based place of a captured text inside its match."""
    return F.greatest(F.instr(whole, part) - 1, F.lit(0))


def _one(registry: str, name: Column, raw: Column, source: str, lookup: str | None = None) -> Column:
    return F.array(_ref(registry, name, raw, _within(raw, F.col("match")), source, lookup))


def _python_modules(modules: Column) -> Column:
    """``import a as b, c.d``: each part with its place in the list."""
    parts = F.split(modules, ",", -1)
    before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda acc, p: acc + F.length(p) + 1)
    base = _within(modules, F.col("match"))

    def ref(p: Column, i: Column) -> Column:
        lead = F.length(p) - F.length(F.ltrim(p))
        raw = F.regexp_replace(F.ltrim(p), r"(?i)\s+as\s+[\s\S]*\z", "")
        return _ref("pypi", nm.python_module(raw), raw, base + before(i) + lead, "import")

    return F.filter(F.transform(parts, ref), lambda r: r["raw"] != "")


def _pip_tokens(arguments: Column, token: str, group: int) -> Column:
    """Requirements among install arguments: options are skipped, and so is the value of an option that takes one."""
    base = _within(arguments, F.col("match"))
    whole = F.regexp_extract_all(arguments, F.lit(token), F.lit(0))
    values = F.regexp_extract_all(arguments, F.lit(token), F.lit(group))
    state = "struct<at:int,skip:boolean,out:array<struct<token:string,off:int>>>"
    zero = F.expr("named_struct('at', 1, 'skip', false, 'out', array())").cast(state)
    flags = F.array(*[F.lit(f) for f in pat.PIP_VALUE_FLAGS])
    lead = 0 if group == 0 else 1

    def step(acc: Column, item: Column) -> Column:
        found = F.call_function("locate", item["w"], arguments, acc["at"])
        flag = ~acc["skip"] & F.array_contains(flags, item["v"])
        use = ~acc["skip"] & ~flag & ~item["v"].rlike("^[-#]")
        entry = F.struct(item["v"].alias("token"), (found - 1 + lead).cast("int").alias("off"))
        return F.struct(
            (found + F.length(item["w"])).cast("int").alias("at"),
            flag.alias("skip"),
            F.when(use, F.array_append(acc["out"], entry)).otherwise(acc["out"]).alias("out"),
        ).cast(state)

    items = F.zip_with(whole, values, lambda w, v: F.struct(w.alias("w"), v.alias("v")))
    tokens = F.aggregate(items, zero, step, lambda acc: acc["out"])
    raw = lambda t: F.regexp_extract(t["token"], pat.PIP_REQUIREMENT, 1)
    return F.transform(tokens, lambda t: _ref("pypi", nm.pypi_package(raw(t)), raw(t), base + t["off"], "install"))


def _go_block(body: Column, entry: str, infer_root: bool, source: str) -> Column:
    entries = F.zip_with(
        F.regexp_extract_all(body, F.lit(entry), F.lit(0)),
        F.regexp_extract_all(body, F.lit(entry), F.lit(1)),
        lambda w, v: F.struct(w.alias("w"), v.alias("v")),
    )
    place = lambda e: _within(e["w"], F.col("match")) + _within(e["v"], e["w"])
    return F.transform(entries, lambda e: _ref("gomod", nm.go_module(e["v"], infer_root), e["v"], place(e), source))


def _xml(tag: str) -> Column:
    return F.trim(F.regexp_extract("match", rf"(?i)<{tag}>\s*([^<]+?)\s*</{tag}>", 1))


def _named(kind: Column) -> Column:
    """References in one match, by kind of file."""
    g = [None] + [F.col(f"g{i}") for i in range(1, pat.GROUPS + 1)]
    has = lambda i: g[i] != ""
    none = F.array().cast(_REF)
    external = F.lit(True)
    for prefix in pat.JVM_PLATFORM_PREFIXES:
        external = external & ~g[1].startswith(prefix)
    group, artifact = _xml("groupId"), _xml("artifactId")
    coordinate = F.when((group != "") & (artifact != "") & ~F.contains(group, F.lit("${")) & ~F.contains(artifact, F.lit("${")), nm.maven_coordinate(group, artifact))
    line = F.trim(F.regexp_replace("match", r"[ \t]#.*\z", ""))
    requirement = F.when(~line.rlike("^[#-]"), F.regexp_extract(line, pat.REQUIREMENT_LINE, 1))
    gradle = nm.maven_coordinate(g[1], g[2])
    quoted = "[\"']([^\"'\\r\\n]+)[\"']"
    py = (
        F.when(has(1), _python_modules(g[1]))
        .when(has(2), _one("pypi", nm.python_module(g[2]), g[2], "import"))
        .when(has(3), _pip_tokens(g[3], r"\S+", 0))
        .when(has(4), _pip_tokens(g[4], quoted, 1))
        .when(has(5), _pip_tokens(g[5], r"\S+", 0))
        .otherwise(none)
    )
    pip = F.when(has(1), _pip_tokens(g[1], r"\S+", 0)).when(has(2), _pip_tokens(g[2], quoted, 1)).when(has(3), _pip_tokens(g[3], r"\S+", 0)).otherwise(none)
    spec = F.coalesce(*[F.nullif(g[i], F.lit("")) for i in (1, 2, 3)])
    return (
        F.when(kind == "javascript", F.when(spec.isNotNull(), _one("npm", nm.npm_package(spec), spec, "import")).otherwise(none))
        .when(kind == "python", py)
        .when(kind == "pip", pip)
        .when(kind == "rust", F.when(has(1), _one("cargo", nm.rust_crate(g[1]), g[1], "import")).otherwise(_one("cargo", nm.rust_crate(g[2]), g[2], "import")))
        .when(kind == "go", F.when(has(1), _one("gomod", nm.go_module(g[1], True), g[1], "import")).otherwise(_go_block(g[2], pat.GO_BLOCK_ENTRY, True, "import")))
        .when(kind == "gomod", F.when(has(1), _one("gomod", nm.go_module(g[1], False), g[1], "manifest")).otherwise(_go_block(g[2], pat.GO_REQUIRE_ENTRY, False, "manifest")))
        .when(kind == "pom", _one("maven", coordinate, artifact, "manifest"))
        .when(kind == "jvm", F.when(external & F.element_at(F.split(g[1], r"\."), -1).rlike("^[A-Z_$]"), _one("maven", g[1], g[1], "import", "class")).otherwise(none))
        .when(kind == "gradle", F.array(_ref("maven", gradle, gradle, _within(g[1], F.col("match")), "manifest")))
        .when(kind == "requirements", F.array(_ref("pypi", nm.pypi_package(requirement), requirement, _within(requirement, F.col("match")), "manifest")))
        .otherwise(none)
    )


def _located(rows: DataFrame) -> DataFrame:
    """Reference rows from matches with their ``refs``; line and column follow from the text before the name."""
    each = rows.select("file", "match", "line", "column", F.explode("refs").alias("r")).filter(
        F.col("r.name").isNotNull() & (F.col("r.raw") != "")
    )

    def at(offset: Column) -> tuple[Column, Column]:
        head = F.left("match", offset)
        breaks = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
        tail = F.length(F.substring_index(head, "\n", -1))
        return F.col("line") + breaks, F.when(breaks > 0, tail + 1).otherwise(F.col("column") + offset)

    (line, column), size = at(F.col("r.off")), F.length("r.raw")
    return each.select(
        "file", F.col("r.registry").alias("registry"), F.col("r.name").alias("package_name"), F.col("r.lookup").alias("lookup"),
        F.col("r.raw").alias("raw_specifier"), line.alias("line"), column.alias("column"), line.alias("end_line"),
        (column + size).alias("end_column"), F.col("r.source").alias("source"),
    )


def refs_by_pattern(corpus: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """References of all pattern-based kinds (or only some) in one scan of the corpus."""
    chosen = list(pat.PATTERNS) if kinds is None else kinds
    pad = lambda p: f"(?:{p})" + "()" * (pat.GROUPS - group_count(p))
    patterns = {i: tx.java_regex(pad(pat.PATTERNS[k]), "im" if k == "pom" else "m") for i, k in enumerate(chosen)}
    number = F.create_map(*[F.lit(x) for i, k in enumerate(chosen) for x in (k, i)])
    rows = corpus.withColumn("kind", file_kind(F.col("file"), F.col("language"))).filter(F.col("kind").isin(chosen))
    named = lambda m: (F.col("kind").isin("pom", "requirements")) | (F.concat(*[m[f"g{i}"] for i in range(1, pat.GROUPS + 1)]) != "")
    spans = regex_spans(
        rows.select("file", "text", "kind", F.struct(F.element_at(number, F.col("kind")).alias("ordinal")).alias("rule")),
        patterns, groups=pat.GROUPS, keep=["file", "kind"], where=named,
    )
    return unique_references(_located(spans.withColumn("refs", _named(F.col("kind")))))


def unique_references(refs: DataFrame) -> DataFrame:
    """One row per (registry, name, line, column) of a file."""
    return refs.select(REFERENCE_COLUMNS).dropDuplicates(["file", "registry", "package_name", "line", "column"])


def _only(kind: str):
    def refs(corpus: DataFrame) -> DataFrame:
        return refs_by_pattern(corpus, [kind])

    refs.__doc__ = f"References of {kind} files."
    return refs


refs_javascript, refs_python, refs_pip_install = _only("javascript"), _only("python"), _only("pip")
refs_rust, refs_go, refs_go_mod = _only("rust"), _only("go"), _only("gomod")
refs_pom, refs_gradle, refs_jvm_imports, refs_requirements = _only("pom"), _only("gradle"), _only("jvm"), _only("requirements")


def refs_package_json(corpus: DataFrame) -> DataFrame:
    """Dependencies of the four sections; local specifiers name no registry package. Invalid JSON yields nothing."""
    rows = corpus.filter(file_kind(F.col("file"), F.col("language")) == "package_json").select("file", "text")
    doc = F.from_json("text", "struct<" + ",".join(f"{s}:map<string,string>" for s in pat.NPM_SECTIONS) + ">")
    entries = F.flatten(
        F.array(*[F.coalesce(F.map_entries(F.col(f"_d.{s}")), F.array().cast("array<struct<key:string,value:string>>")) for s in pat.NPM_SECTIONS])
    )
    each = rows.withColumn("_d", doc).select("file", "text", F.explode(entries).alias("e"))
    value = F.lower(F.trim(F.coalesce("e.value", F.lit(""))))
    local = F.lit(False)
    for prefix in pat.LOCAL_NPM_PREFIXES:
        local = local | value.startswith(prefix)
    name = F.col("e.key")
    # A name is text from the file: one that holds the end mark of a quotation must not break the pattern.
    quoted = F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    key = F.regexp_instr("text", F.concat(F.lit('"\\Q'), quoted, F.lit('\\E"\\s*:')))
    placed = each.filter(~local).withColumn("name", name).withColumn(
        "_at", F.when(key > 0, key - 1).otherwise(F.greatest(F.instr("text", name) - 1, F.lit(0)))
    )
    placed = with_positions(placed, "_at")
    return unique_references(
        placed.select(
            "file", F.lit("npm").alias("registry"), F.col("name").alias("package_name"), F.lit(None).cast("string").alias("lookup"),
            F.col("name").alias("raw_specifier"), "line", "column", F.col("line").alias("end_line"),
            (F.col("column") + F.length("name")).alias("end_column"), F.lit("manifest").alias("source"),
        )
    )


# Sections and entries of the section-based manifests.
_SECTION = r"^\[([^\]]+)\]\z"
_CARGO_SECTION = (
    r"^(?:(?:workspace\.)?(?:dependencies|dev-dependencies|build-dependencies)"
    r"|target\.[^.]+(?:\.[^.]+)*\.(?:dependencies|dev-dependencies|build-dependencies))\z"
)
_CARGO_LOCAL = r"""\b(?:path|git|registry)\s*=\s*["']"""
_PYPROJECT_ITEM = r"""["']([A-Za-z0-9_.-]+)(?:\[[^\]]+])?(?:[<>=!~]=?[^"']*)?["']"""


def toml_lines(corpus: DataFrame, kinds: list[str]) -> DataFrame:
    """Non-blank lines of section-based manifests with the section they belong to, comments removed.

    The section of a line is the last header above it: a running ``last`` over the lines of one manifest.
    """
    rows = corpus.withColumn("kind", file_kind(F.col("file"), F.col("language"))).filter(F.col("kind").isin(kinds))
    lines = rows.select("file", "kind", F.posexplode(F.split("text", "\r?\n", -1)).alias("_i", "text"))
    bare = F.trim(F.regexp_replace("text", r"""^((?:[^#"']|"(?:\\.|[^"\\])*"|'[^']*')*)#.*\z""", "$1"))
    lines = lines.withColumn("bare", bare).filter("bare <> ''").withColumn("line", F.col("_i") + 1)
    header = F.nullif(F.regexp_extract("bare", _SECTION, 1), F.lit(""))
    above = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("header", header).withColumn("section", F.coalesce(F.last("header", True).over(above), F.lit("")))


def refs_toml(corpus: DataFrame, kinds: tuple[str, ...] = ("pyproject", "cargo", "catalog")) -> DataFrame:
    """References of ``pyproject.toml``, ``Cargo.toml`` and Gradle version catalogues."""
    lines = toml_lines(corpus, list(kinds))
    kind, bare, lower = F.col("kind"), F.col("bare"), F.lower(F.trim("section"))
    # A dependency array is open from its first line to the first line with a closing bracket or the next section.
    opens = (kind == "pyproject") & F.col("header").isNull() & F.contains(bare, F.lit("=")) & F.contains(bare, F.lit("[")) & (
        ((lower == "project") & bare.rlike(r"^dependencies\s*="))
        | ((lower == "build-system") & bare.rlike(r"^requires\s*="))
        | (lower == "project.optional-dependencies")
    )
    resets = F.contains(bare, F.lit("]")) | F.col("header").isNotNull()
    by_file = Window.partitionBy("file").orderBy("line")
    opened = F.max(F.when(opens, F.col("line"))).over(by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reset = F.max(F.when(resets, F.col("line"))).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.withColumn("in_array", F.coalesce(opened > F.coalesce(reset, F.lit(0)), F.lit(False))).filter(F.col("header").isNull())

    none = F.array().cast(_REF)
    poetry = (lower == "tool.poetry.dependencies") | (lower.startswith("tool.poetry.group.") & lower.endswith(".dependencies"))
    dep = F.regexp_extract(bare, r"""^["']?([A-Za-z0-9_.-]+)["']?\s*=""", 1)
    place = lambda raw: _within(raw, F.col("match"))
    poetry_refs = F.when(poetry & (dep != "") & (F.lower(dep) != "python"), F.array(_ref("pypi", nm.pypi_package(dep), dep, place(dep), "manifest"))).otherwise(none)
    items = F.zip_with(
        F.regexp_extract_all("match", F.lit(_PYPROJECT_ITEM), F.lit(0)), F.regexp_extract_all("match", F.lit(_PYPROJECT_ITEM), F.lit(1)),
        lambda w, v: F.struct(w.alias("w"), v.alias("v")),
    )
    array_refs = F.when(
        F.col("in_array"),
        F.transform(items, lambda e: _ref("pypi", nm.pypi_package(e["v"]), e["v"], place(e["w"]) + 1, "manifest")),
    ).otherwise(none)
    renamed = F.regexp_extract(bare, tx.java_regex(r"""\bpackage\s*=\s*["']([A-Za-z0-9_-]+)["']"""), 1)
    crate = F.coalesce(F.nullif(renamed, F.lit("")), F.nullif(F.regexp_extract(bare, r"^([A-Za-z0-9_-]+)\s*=", 1), F.lit("")))
    cargo_refs = F.when(
        F.col("section").rlike(_CARGO_SECTION) & ~bare.rlike(tx.java_regex(_CARGO_LOCAL)) & crate.isNotNull(),
        F.array(_ref("cargo", crate, crate, place(crate), "manifest")),
    ).otherwise(none)
    pick = lambda p, i: F.nullif(F.regexp_extract(bare, tx.java_regex(p), i), F.lit(""))
    module = r"""\bmodule\s*=\s*["']([^:"']+):([^:"']+)["']"""
    direct = r"""^\s*[A-Za-z0-9_.-]+\s*=\s*["']([^:"']+):([^:"']+)(?::[^"']+)?["']\s*\z"""
    coordinate = F.coalesce(
        nm.maven_coordinate(pick(module, 1), pick(module, 2)),
        nm.maven_coordinate(pick(r"""\bgroup\s*=\s*["']([^"']+)["']""", 1), pick(r"""\bname\s*=\s*["']([^"']+)["']""", 1)),
        nm.maven_coordinate(pick(direct, 1), pick(direct, 2)),
    )
    catalog_refs = F.when((F.trim("section") == "libraries") & coordinate.isNotNull(), F.array(_ref("maven", coordinate, coordinate, place(coordinate), "manifest"))).otherwise(none)
    rows = rows.withColumn("match", F.col("text")).withColumn("column", F.lit(1))
    refs = (
        F.when(kind == "pyproject", F.concat(poetry_refs, array_refs)).when(kind == "cargo", cargo_refs).otherwise(catalog_refs)
    )
    return unique_references(_located(rows.withColumn("refs", refs)))


def extract_references(corpus: DataFrame) -> DataFrame:
    """References of every supported file."""
    return refs_by_pattern(corpus).unionByName(refs_package_json(corpus)).unionByName(refs_toml(corpus))

"""Package-name lists in the shapes registries and exports publish them.

Input is a table of landed responses ``(registry, page, body)``; one row per name comes out, with the page it was on, its
``position`` and the ``total`` the registry claims. A response that does not parse yields no names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import java_regex

# Markup of a name listing and the entities decoded in it, in this order.
ANCHOR = r"(?is)<a\b[^>]*>(.*?)</a>"
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("(?i)&#x2F;", "/")]
DESIGN_PREFIX = "_design/"


def _filled(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def _names(pages: DataFrame, names: Column, total: Column | None = None) -> DataFrame:
    claimed = F.lit(None) if total is None else total
    return (
        pages.select("registry", "page", claimed.cast("bigint").alias("total"), F.posexplode(names).alias("position", "name"))
        .filter(F.col("name").isNotNull())
        .select("registry", "page", "position", "name", "total")
    )


def names_from_npm_docs(pages: DataFrame) -> DataFrame:
    """``{"total_rows": n, "rows": [{"id"|"key": name}]}`` without design documents."""
    doc = F.from_json("body", "struct<total_rows:bigint,rows:array<struct<id:string,key:string>>>")
    rows = pages.withColumn("_d", doc)
    name = lambda r: F.coalesce(_filled(r["id"]), _filled(r["key"]))
    names = F.transform(F.col("_d.rows"), lambda r: F.when(~name(r).startswith(DESIGN_PREFIX), name(r)))
    return _names(rows, names, F.col("_d.total_rows"))


def names_from_anchor_html(pages: DataFrame) -> DataFrame:
    """Text of every link: tags removed, entities decoded, trimmed, empty ones dropped."""

    def clean(text: Column) -> Column:
        out = F.regexp_replace(text, "<[^>]+>", "")
        for pattern, value in ENTITIES:
            out = F.regexp_replace(out, pattern, value)
        out = F.trim(out)
        return F.when(out != "", out)

    anchors = F.regexp_extract_all("body", F.lit(java_regex(ANCHOR)), F.lit(1))
    return _names(pages, F.transform(anchors, clean))


def names_from_crates(pages: DataFrame) -> DataFrame:
    """``{"crates": [{"id"|"name"}], "meta": {"total": n}}``."""
    doc = F.from_json("body", "struct<crates:array<struct<id:string,name:string>>,meta:struct<total:bigint>>")
    rows = pages.withColumn("_d", doc)
    names = F.transform(F.col("_d.crates"), lambda c: F.coalesce(_filled(c["id"]), _filled(c["name"])))
    return _names(rows, names, F.col("_d.meta.total"))


def names_from_module_index(pages: DataFrame) -> DataFrame:
    """JSON lines with ``Path``; malformed lines are skipped."""
    names = F.transform(F.split("body", "\r?\n", -1), lambda line: _filled(F.get_json_object(line, "$.Path")))
    return _names(pages, names)


def names_from_maven_search(pages: DataFrame) -> DataFrame:
    """``{"response": {"numFound": n, "docs": [{"g", "a"} | {"id"}]}}`` as ``group:artifact``."""
    doc = F.from_json("body", "struct<response:struct<numFound:bigint,docs:array<struct<g:string,a:string,id:string>>>>")
    rows = pages.withColumn("_d", doc)

    def coordinate(d: Column) -> Column:
        pair = F.when(_filled(d["g"]).isNotNull() & _filled(d["a"]).isNotNull(), F.concat(d["g"], F.lit(":"), d["a"]))
        return F.coalesce(pair, F.when(F.contains(d["id"], F.lit(":")), _filled(d["id"])))

    return _names(rows, F.transform(F.col("_d.response.docs"), coordinate), F.col("_d.response.numFound"))


def _unquoted(name: Column) -> Column:
    cleaned = F.regexp_replace(F.trim(name), r'^"|"\z', "")
    return F.when(cleaned != "", cleaned)


def read_package_list(lists: DataFrame) -> DataFrame:
    """Exported lists ``(registry, page, body)`` in four shapes, recognised per list: a JSON array, an object with
    ``rows`` or ``packages``, or lines with ``#`` comments. Adds the ``format``."""
    body = F.trim("body")
    array = F.when(body.startswith("["), F.try_parse_json(body))
    obj = F.when(body.startswith("{"), F.try_parse_json(body))
    rows = lists.withColumn("_a", array).withColumn("_o", obj)
    strings = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    row_name = lambda r: F.coalesce(
        _filled(F.try_variant_get(r, "$.id", "string")), _filled(F.try_variant_get(r, "$.key", "string"))
    )
    lines = F.transform(F.split("body", "\r?\n", -1), lambda line: _unquoted(F.substring_index(line, "#", 1)))
    items = F.when(strings(F.col("_a"), "$").isNotNull(), F.transform(strings(F.col("_a"), "$"), lambda v: _unquoted(text(v))))
    listed = F.when(
        strings(F.col("_o"), "$.rows").isNotNull(), F.transform(strings(F.col("_o"), "$.rows"), lambda v: _unquoted(row_name(v)))
    )
    packed = F.when(
        strings(F.col("_o"), "$.packages").isNotNull(),
        F.transform(strings(F.col("_o"), "$.packages"), lambda v: _unquoted(text(v))),
    )
    shape = (
        F.when(items.isNotNull(), "json-array").when(listed.isNotNull(), "json-rows").when(packed.isNotNull(), "json-packages").otherwise("line-list")
    )
    rows = rows.withColumn("format", shape).withColumn("_names", F.coalesce(items, listed, packed, lines))
    return (
        rows.select("registry", "page", "format", F.posexplode("_names").alias("position", "name"))
        .filter(F.col("name").isNotNull())
        .withColumn("total", F.lit(None).cast("bigint"))
    )


def npm_changes(feeds: DataFrame) -> DataFrame:
    """Change feed pages ``(registry, page, body)``: ``{"results": [{"id", "deleted"}], "last_seq"}`` as ordered changes."""
    doc = F.from_json("body", "struct<results:array<struct<id:string,deleted:boolean>>,last_seq:string>")
    rows = feeds.withColumn("_d", doc).select("registry", "page", F.col("_d.last_seq").alias("last_seq"), F.posexplode("_d.results").alias("position", "r"))
    return rows.filter((F.trim("r.id") != "") & ~F.col("r.id").startswith(DESIGN_PREFIX)).select(
        "registry",
        F.col("r.id").alias("package_name"),
        F.coalesce(F.col("r.deleted"), F.lit(False)).alias("deleted"),
        F.struct("page", "position").alias("seq"),
        "last_seq",
    )

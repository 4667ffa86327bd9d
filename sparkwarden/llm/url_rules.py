"""URL filtering by host and path rules and, where none fits, by association rules mined with FP-growth.

Everything is DataFrame functions and Spark's own FP-growth; there is no Python in any task.

Explicit rules label the urls they fit. Those labels and the tokens of the urls (host labels with their level, path segments,
digits masked) are the transactions. Tokens that the explicit rules name are left out: the labels are a function of them, so they
would only say the rules again, for urls that the rules leave open. FP-growth gives the frequent token combinations; a combination of at most
``max_tokens`` tokens whose share of one label reaches ``min_confidence`` becomes a rule, unless a part of it already says
the same as surely. Rules are filed under one token each in an inverted index; a url looks its tokens up, keeps the rules
whose tokens it holds all of, and takes the most confident (then best supported, then block before allow).

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and gets the default verdict. Each
input row gives one output row, also repeated ones. Empty tables give no rows. Without labels every url that no rule fits gets
the default verdict.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLASS = "verdict="
#: A mined rule set this small (rows) may be sent to every task; beyond it the join is left to shuffles.
BROADCAST_RULES = 5_000


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels counted from the right, and path segments with digit runs masked."""
    labels = F.reverse(F.split(host, r"\."))
    hosts = F.transform(labels, lambda x, i: F.when(i < 3, F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x)).otherwise(F.concat(F.lit("h3:"), x)))
    parts = F.transform(F.split(path, r"[/._-]+"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "#")))
    return F.array_distinct(F.filter(F.concat(hosts, parts), lambda x: ~x.rlike(r"^[hp0-9]+:$")))


def named_tokens(rules: list[UrlRule]) -> list[str]:
    """The tokens in which the explicit rules are written, as ``url_tokens`` spells them."""
    hosts = {f"h{min(i, 3)}:{x}" for r in rules for i, x in enumerate(reversed(r.host.split(".")))}
    return sorted(hosts | {f"p:{x}" for r in rules for x in re.split(r"[/._-]+", re.sub("[0-9]+", "#", r.path)) if x})


def mine_rules(
    labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.9, max_tokens: int = 3
) -> DataFrame:
    """``tokens, verdict, confidence, support`` of the rules kept, from ``tokens, verdict`` of labelled urls."""
    items = labelled.select(F.array_append("tokens", F.concat(F.lit(_CLASS), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    sets = model.freqItemsets.select(
        F.array_sort(F.filter("items", lambda x: ~x.startswith(_CLASS))).alias("tokens"),
        F.filter("items", lambda x: x.startswith(_CLASS)).alias("label"),
        "freq",
    ).filter(F.size("tokens").between(1, max_tokens) & (F.size("label") <= 1))
    whole = sets.filter(F.size("label") == 0).select("tokens", F.col("freq").alias("total"))
    of_class = sets.filter(F.size("label") == 1).select("tokens", F.substr(F.col("label")[0], F.lit(len(_CLASS) + 1)).alias("verdict"), "freq")
    rules = of_class.join(whole, "tokens").select(
        "tokens", "verdict", (F.col("freq") / F.col("total")).alias("confidence"), F.col("freq").alias("support")
    ).filter(F.col("confidence") >= min_confidence)
    parts = rules.filter(F.size("tokens") > 1).select(
        "tokens", "verdict", "confidence",
        F.explode(F.concat(F.transform("tokens", lambda x: F.array(x)), F.transform("tokens", lambda x: F.array_remove(F.col("tokens"), x)))).alias("part"),
    )
    weaker = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("part_confidence"))
    needless = parts.join(weaker, ["part", "verdict"]).filter(
        (F.size("part") < F.size("tokens")) & (F.col("part_confidence") >= F.col("confidence"))
    ).select("tokens", "verdict").distinct()
    return rules.join(needless, ["tokens", "verdict"], "left_anti")


def mined_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens, mined`` for each distinct token set of ``urls`` that a mined rule matches."""
    rules = rules.select(
        F.element_at("tokens", -1).alias("token"), F.col("tokens").alias("needs"), F.col("verdict").alias("mined"), "confidence", "support"
    )
    if rules.count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    sets = urls.select("tokens").distinct()
    hits = sets.withColumn("token", F.explode("tokens")).join(rules, "token")
    hits = hits.filter(F.size(F.array_except("needs", "tokens")) == 0)
    order = F.struct("confidence", "support", (F.col("mined") == "block").alias("blocks"))
    return hits.groupBy("tokens").agg(F.max_by("mined", order).alias("mined"))


def filter_urls(
    pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url", default: str = "allow",
    min_support: float = 0.002, min_confidence: float = 0.9, max_tokens: int = 3,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` for every page; ``mined`` tells that an association rule decided."""
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    base = base.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    named = F.array(*(F.lit(x) for x in named_tokens(rules))).cast("array<string>")
    base = base.withColumn("tokens", F.array_except(url_tokens(F.col("host"), F.col("path")), named))
    labelled = base.filter(F.col("fit").isNotNull()).select("tokens", F.col("fit.verdict").alias("verdict"))
    open_urls = base.filter(F.col("fit").isNull())
    mined = mined_verdicts(open_urls, mine_rules(labelled, min_support, min_confidence, max_tokens))
    done = base.filter(F.col("fit").isNotNull()).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"), F.lit(False).alias("mined")
    )
    rest = open_urls.join(mined, "tokens", "left").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
        F.coalesce("mined", F.lit(default)).alias("verdict"), F.col("mined").isNotNull().alias("mined"),
    )
    return done.unionByName(rest)

"""URL filters: a list of host and path rules, and rules mined by FP-growth from labels.

DataFrame functions and Spark's own FP-growth only.
"""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from panelfold.session import materialize

# Host and path prefix -> verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
SUPPORT, CONFIDENCE, LIFT = 0.001, 0.6, 1.2
BLOCK, ALLOW = "=block", "=allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str = "url") -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*+)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*+([^?#]*+)", 1)


def tokens(url: str = "url") -> Column:
    """What a URL is made of: host and its parent domain, top level, subdomain, first
    directory, form of the last part, query keys and fragment. Sorted, none twice."""
    name, way = host(url), path(url)
    labels = F.split(name, r"\.")
    text = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.concat(F.lit("query:"), F.regexp_extract(p, "^[^=]*", 0)))
    last = F.regexp_extract(way, r"([^/]*)/?$", 1)
    form = F.concat(F.lit("form:"), F.regexp_replace(F.regexp_replace(F.substring(last, -12, 12), "[0-9]+", "0"),
                                                     "[A-Za-z]{6,}", "w"))
    some = F.array(
        F.when(name != "", F.concat(F.lit("host:"), name)),
        F.when(F.size(labels) > 2, F.concat(F.lit("domain:"), F.array_join(F.slice(labels, -2, 2), "."))),
        F.when(name != "", F.concat(F.lit("top:"), F.element_at(labels, -1))),
        F.when(F.size(labels) > 2, F.concat(F.lit("sub:"), F.element_at(labels, 1))),
        F.when(way.rlike("^/[^/]+/"), F.concat(F.lit("dir:"), F.regexp_extract(way, "^/([^/]+)/", 1))),
        F.when(last != "", form),
        F.when(text.contains("#"), F.lit("fragment")))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(
        some, F.when(query != "", F.slice(keys, 1, 4)).otherwise(F.array().cast("array<string>"))))))


def mine(labelled: DataFrame, support=SUPPORT, confidence=CONFIDENCE, lift=LIFT) -> DataFrame:
    """``(rule, items, verdict, confidence, support)`` from rows (url, bad: 0 or 1).

    FP-growth finds combinations of URL tokens and a verdict; rules that conclude a
    verdict stay if confidence, support and lift reach the limits and no part of them
    is as sure. All labelled rows are mined; their number bounds nothing.
    """
    baskets = materialize(
        labelled.where("bad is not null")
        .select(F.array_append(tokens("url"), F.when(F.col("bad") > 0, BLOCK).otherwise(ALLOW)).alias("items")),
        "baskets")
    columns = "rule string, items array<string>, verdict string, confidence double, support double"
    if baskets.isEmpty():
        return labelled.sparkSession.createDataFrame([], columns)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = (model.associationRules
             .where(F.element_at("consequent", 1).isin(BLOCK, ALLOW) & (F.col("lift") >= lift))
             .select(F.array_sort("antecedent").alias("items"), F.col("confidence"), F.col("support"),
                     F.substring(F.element_at("consequent", 1), 2, 10).alias("verdict"))
             .where(~F.exists("items", lambda x: x.isin(BLOCK, ALLOW))))
    found = materialize(found.withColumn("rule", F.array_join("items", " ")), "mined")
    # A rule is idle if one token less concludes the same as surely.
    shorter = found.select("verdict", F.col("rule").alias("r"), F.col("confidence").alias("c"))
    parts = found.where(F.size("items") > 1).select(
        "rule", "verdict", "confidence", F.explode("items").alias("token"), "items")
    idle = (parts.withColumn("r", F.array_join(F.array_remove("items", F.col("token")), " "))
            .join(shorter, ["verdict", "r"]).where(F.col("c") >= F.col("confidence"))
            .select("rule", "verdict").distinct())
    return found.join(idle, ["rule", "verdict"], "left_anti").select(
        "rule", "items", "verdict", "confidence", "support")


def _best_rule(urls: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Longest fitting listed rule of every distinct (host, path)."""
    rows = [(r.partition("/")[0], r[len(r.partition("/")[0]):], r, v) for r, v in rules.items()]
    spark = urls.sparkSession
    table = spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, listed string")
    deepest = max([r[0].count(".") + 1 for r in rows], default=0)
    labels = F.split("host", r"\.")
    ends = F.array(*[F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), "."))
                     for k in range(1, deepest + 1)]) if deepest else F.array().cast("array<string>")
    return (urls.select("host", "path").distinct()
            .select("host", "path", F.explode(ends).alias("rule_host")).where("rule_host is not null")
            .join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "listed")).alias("best"))
            .select(F.col("host").alias("h"), F.col("path").alias("p"), "best.rule", "best.listed"))


def _mined_verdict(urls: DataFrame, mined: DataFrame) -> DataFrame:
    """The surest mined rule of every distinct token set, by an inverted index.

    A rule is filed under its rarest token, so that common tokens call up few rules;
    what it calls up is checked against the whole token set.
    """
    items = mined.select(F.explode("items").alias("token"))
    often = items.groupBy("token").count()
    seen = (urls.select("key", F.explode("items").alias("token")).groupBy("token")
            .agg(F.count("*").alias("uses")).join(often, "token").select("token", "uses"))
    filed = (mined.select("*", F.explode("items").alias("token")).join(seen, "token")
             .groupBy("rule", "verdict").agg(F.min(F.struct("uses", "token")).alias("f"),
                                             F.first("items").alias("rule_items"),
                                             F.first("confidence").alias("confidence"),
                                             F.first("support").alias("support"))
             .select("rule", "verdict", "confidence", "support", "rule_items", F.col("f.token").alias("token")))
    filed = materialize(filed, "filed")
    sets = materialize(urls.groupBy("key").agg(F.first("items").alias("items")), "sets")
    return (sets.select("key", "items", F.explode("items").alias("token")).join(filed, "token")
            .where(F.size(F.array_except("rule_items", "items")) == 0)
            .groupBy("key").agg(F.max(F.struct("confidence", "support", "rule", "verdict")).alias("m"))
            .select(F.col("key").alias("k"), F.col("m.rule").alias("mined_rule"),
                    F.col("m.verdict").alias("mined")))


def judge(pages: DataFrame, labelled: DataFrame, rules: dict[str, str] | None = None,
          support=SUPPORT, confidence=CONFIDENCE, lift=LIFT, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rule`` of every row of ``pages``.

    A listed rule fits its host and all subdomains if the path starts with its
    path; the longest wins and decides. Otherwise the surest mined rule decides (by
    confidence, support, name), else ``default``. ``labelled`` has url and bad (0, 1 or
    null). Null URLs and those without "://" have empty host and path. Null and
    repeated ids pass through. Without labels nothing is mined; no pages, no rows.
    """
    rules = RULES if rules is None else rules
    urls = materialize(
        pages.select("page_id", host().alias("host"), path().alias("path"), tokens().alias("items"))
        .withColumn("key", F.md5(F.array_join("items", " "))), "urls")
    listed = materialize(_best_rule(urls, rules), "listed")
    mined = materialize(_mined_verdict(urls, mine(labelled, support, confidence, lift)), "verdicts")
    return (urls.drop("items")
            .join(listed, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
            .join(mined, F.col("key") == F.col("k"), "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("listed", "mined", F.lit(default)).alias("verdict"),
                    F.when(F.col("rule").isNull(), F.col("mined_rule")).alias("mined_rule")))


def document_number(url: str = "url") -> Column:
    """The number that ends a page's path: the document it shows."""
    return F.expr(f"try_cast(regexp_extract({url}, '([0-9]+)[^0-9/?#]*/?([?#].*)?$', 1) as bigint)")

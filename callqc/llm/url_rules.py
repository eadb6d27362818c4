"""URL filters: host rules, and rules mined from labelled URLs by FP-growth.

A URL's tokens (parts of its host, words of its path and query) together with its class make
a transaction.  Tokens that stand in exactly the same labelled URLs (the parts of one template) are
one item, so a template of many tokens is mined as one and not in all its parts.  Frequent
combinations that hold the blocking class give rules "these tokens, hence block"; rules of too
few hits, too little confidence, support or lift are pruned, also those whose confidence could
be chance, and so is a rule that a shorter one of at least its confidence already covers.  The
rules are matched through an inverted index: a URL's tokens are looked up in it, and a rule
fires where it was found once for each of its tokens.  Everything is made of DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callqc.llm.common import written

Rule = tuple[str, str, str]  # verdict, host, path

#: Shares of the labelled URLs, and of the URLs with the tokens, from which a rule holds, and
#: the least ratio to the share of blocked URLs overall.
SUPPORT, CONFIDENCE, LIFT = 0.002, 0.7, 1.5
#: Blocked URLs that a rule rests on at least, and the standard errors that its confidence must lie
#: above the share of blocked URLs (the lower Wilson bound).
HITS, SURE = 3, 1.64
#: Host rules that are written into the plan; more are joined by host suffix.
PLAN_RULES = 500
ALLOW, BLOCK = "allow", "block"
_CLASS = "\x00block"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a ``://``."""
    return F.regexp_extract(_rest(url), r"(?s)\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(F.coalesce(at, F.lit(0)) > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_rule(rules: Sequence[Rule], host_col: Column, path_col: Column) -> Column:
    """The longest rule (host and path) that fits, as ``struct(rule, verdict)``; null if none does.

    Of rules that are equally long the one of the longer host wins, then the first by name.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2], r[0]))
    if not ranked:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    found = None
    for verdict, name, begin in ranked:
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(begin)
        value = F.struct(F.lit(name + begin).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def with_host_rule(named: DataFrame, rules: Sequence[Rule], name: str) -> DataFrame:
    """``named`` (``host, path``) with ``host_rule`` as the column ``name``, for any number of rules."""
    if len(rules) <= PLAN_RULES:
        return named.withColumn(name, host_rule(rules, F.col("host"), F.col("path")))
    known = named.sparkSession.createDataFrame([(h, h + p, v, p) for v, h, p in rules], "suffix string, rule string, verdict string, begin string")
    # every host once, with the rules of its name and of all that it is a subdomain of
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    own = (named.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(known, "suffix")
           .groupBy("host").agg(F.collect_list(F.struct(-F.length("rule"), -F.length("suffix"), "rule", "verdict", "begin")).alias("_own")))
    fits = F.array_min(F.filter("_own", lambda x: F.col("path").startswith(x["begin"])))
    found = F.when(fits.isNotNull(), F.struct(fits["rule"].alias("rule"), fits["verdict"].alias("verdict")))
    return named.join(own, "host", "left").withColumn(name, found).drop("_own")


def tokens(url: Column) -> Column:
    """Different tokens of a URL: its host's name parts, its path's first directory, words of the
    path, names of its parameters; numbers are one token."""
    query = F.regexp_extract(_rest(url), r"(?s)\?([^#]*)", 1)
    names = F.filter(F.split(host(url), r"\."), lambda x: x != "")
    words = F.filter(F.split(F.regexp_replace(F.lower(path(url)), r"[0-9]+", "0"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.lower(F.split(x, "=")[0])), lambda x: x != "")
    return F.array_distinct(F.concat(F.transform(names, lambda x: F.concat(F.lit("host:"), x)),
                                     F.transform(words, lambda x: F.concat(F.lit("path:"), x)),
                                     F.transform(keys, lambda x: F.concat(F.lit("query:"), x))))


def mine(
    labelled: DataFrame, url_col: str, block_col: str, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT,
    hits: int = HITS, sure: float = SURE,
) -> DataFrame:
    """Rules ``rule_id, tokens, confidence, support, lift, hits`` that block, from labelled URLs.

    Rows of a null URL or class are not used.  Without blocked URLs there are no rules.  Repeated
    URLs count each; tokens that always stand together stand in a rule together.
    """
    used = labelled.where(F.col(url_col).isNotNull() & F.col(block_col).isNotNull())
    urls = written(used.select(F.monotonically_increasing_id().alias("row"), tokens(F.col(url_col)).alias("tokens"), F.col(block_col).alias("blocked")), "url-tokens")
    n, n_blocked = urls.agg(F.count("*"), F.count_if("blocked")).first()
    if not n_blocked:
        return urls.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double, lift double, hits long")
    # where a token stands, as two hashes of the set of its URLs; equal sets are one item
    where = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit("b"))).alias("b"))
    stands = (urls.select("row", "blocked", F.explode("tokens").alias("token")).groupBy("token").agg(where.alias("set"), F.count_if("blocked").alias("hits"))
              .where(F.col("hits") >= hits))
    items = written(stands.groupBy("set").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("members")), "url-items")
    named = urls.select("row", "blocked", F.explode("tokens").alias("item")).join(items.select("item"), "item")
    baskets = named.groupBy("row").agg(F.collect_list("item").alias("own"), F.first("blocked").alias("blocked")).select(
        F.concat("own", F.when(F.col("blocked"), F.array(F.lit(_CLASS))).otherwise(F.array().cast("array<string>"))).alias("items"))
    least = max(support, (hits - 0.5) / n)
    # FP-growth counts shares of its own rows: URLs without any item are rows too
    rest = urls.join(named.select("row").distinct(), "row", "left_anti").select(F.when(F.col("blocked"), F.array(F.lit(_CLASS))).otherwise(F.array().cast("array<string>")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(written(baskets.unionByName(rest), "url-baskets"))
    # rules from the frequent combinations: those with the class against those without it
    sets = written(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-sets")
    blocked = sets.where(F.array_contains("items", _CLASS)).select(
        F.array_remove("items", _CLASS).alias("tokens"), F.col("freq").alias("hits"))
    p, m, z = F.col("hits") / F.col("freq"), F.col("freq"), F.lit(sure)
    lowest = (p + z * z / (2 * m) - z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    rules = (blocked.where(F.size("tokens") > 0)
             .join(sets.select(F.col("items").alias("tokens"), "freq"), "tokens")
             .select("tokens", p.alias("confidence"), (F.col("hits") / n).alias("support"), (p * n / n_blocked).alias("lift"), "hits", lowest.alias("lowest"))
             .where((F.col("confidence") >= confidence) & (F.col("lift") >= lift) & (F.col("lowest") > n_blocked / n)).drop("lowest")
             .withColumn("rule_id", F.xxhash64(F.array_join("tokens", "\x00"))))
    rules = written(rules, "url-rules")
    # a shorter rule of at least the same confidence that a rule contains makes it needless
    part = _index(rules).join(_index(rules).select("token", F.col("rule_id").alias("inner"), F.col("need").alias("inner_need")), "token")
    covered = (part.where("inner <> rule_id AND inner_need < need").groupBy("rule_id", "inner", "inner_need").agg(F.count("*").alias("shared"))
               .where("shared = inner_need").join(rules.select(F.col("rule_id").alias("inner"), F.col("confidence").alias("inner_confidence")), "inner")
               .join(rules.select("rule_id", "confidence"), "rule_id").where("inner_confidence >= confidence").select("rule_id").distinct())
    kept = rules.join(covered, "rule_id", "left_anti")
    whole = (kept.select("rule_id", F.explode("tokens").alias("item")).join(items.select("item", "members"), "item")
             .groupBy("rule_id").agg(F.sort_array(F.flatten(F.collect_list("members"))).alias("tokens")))
    return kept.drop("tokens").join(whole, "rule_id").select("rule_id", "tokens", "confidence", "support", "lift", "hits")


def _index(rules: DataFrame) -> DataFrame:
    """Inverted index of rules: ``token, rule_id, need``."""
    return rules.select(F.explode("tokens").alias("token"), "rule_id", F.size("tokens").alias("need"))


def judge(
    pages: DataFrame, rules: Sequence[Rule], mined: DataFrame, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rule, confidence`` for every row.

    ``rule`` is the host rule that decides, else null; where none fits, a URL is blocked if
    a mined rule fires (``mined_rule`` its tokens, of the highest confidence; ties go to the
    first by name), else allowed.  A null URL, and one without ``://``, has an empty host and
    path and no tokens, so it is allowed.  Repeated rows keep a row each; an empty table
    gives an empty result; other columns are not read.
    """
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")).select(
        "page_id", "_url", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"))
    ruled = with_host_rule(named, rules, "_rule")
    # the method judges each different URL once
    open_urls = ruled.where("_rule IS NULL AND _url IS NOT NULL").select("_url").distinct()
    found = (open_urls.select("_url", F.explode(tokens(F.col("_url"))).alias("token")).join(_index(mined), "token")
             .groupBy("_url", "rule_id", "need").agg(F.count("*").alias("found")).where("found = need"))
    best = (found.join(mined.select("rule_id", "tokens", "confidence"), "rule_id")
            .groupBy("_url").agg(F.min(F.struct((-F.col("confidence")).alias("order"), F.array_join("tokens", " ").alias("mined_rule"),
                                                F.col("confidence"))).alias("best"))
            .select("_url", "best.mined_rule", "best.confidence"))
    return ruled.join(best, "_url", "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.when(F.col("_rule").isNotNull(), F.col("_rule.verdict")).when(F.col("mined_rule").isNotNull(), F.lit(BLOCK))
        .otherwise(F.lit(ALLOW)).alias("verdict"),
        F.when(F.col("_rule").isNull(), F.col("mined_rule")).alias("mined_rule"),
        F.when(F.col("_rule").isNull(), F.col("confidence")).alias("confidence"))

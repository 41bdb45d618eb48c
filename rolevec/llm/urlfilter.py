"""URL filters mined from labels by association rules, on DataFrame operations only.

A url's tokens (host labels and their endings, path words, query words, marked by
place) form a transaction; pages with a label add the item of their class.  Spark ML's
FP-growth mines token combinations; rules "tokens -> bad" are kept by support,
confidence and lift, and a rule goes if a part of its tokens is at least as certain.
Tokens that occur in exactly the same labelled urls (a host's labels, a template's words)
are one item for the miner, so its work doesn't double with each of them; a rule holds for
any of an item's tokens.  Lift is measured against all labelled urls.
A rule is indexed by its rarest item; urls meet it there and must hold all its items.

Hand-written rules (host and path prefix) come first; the longest fitting one wins.
Verdicts are computed once per distinct url.  The mined rules are written first, so
the planner sees their size and broadcasts them while they are small.

Defined results: a null url or one without ``://`` has empty host and path, no tokens,
and is allowed; equal urls get equal verdicts; without labels nothing is mined; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolevec.session import checkpoint_dir, stage_table

MIN_SUPPORT = 0.002  # share of the labelled urls that hold a rule's tokens and are bad
MIN_COUNT = 15  # and at least so many of them
MIN_CONFIDENCE = 0.7
MIN_LIFT = 1.5
MAX_TOKENS = 3  # of a rule
BAD = "class:bad"

#: (verdict, host, path): the rule holds for the host and its subdomains, for paths that start so.
HAND_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def tokens_of(url: Column) -> Column:
    """Distinct items of a url, marked by the place they stand in; numbers are left out."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)

    def words(text: Column, mark: str) -> Column:
        parts = F.filter(F.split(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.rlike(r"^\p{N}+$"))
        return F.transform(parts, lambda w: F.concat(F.lit(mark), w))

    hosts = F.transform(F.filter(host_suffixes(host), lambda h: h != ""), lambda h: F.concat(F.lit("host:"), h))
    items = F.array_distinct(F.concat(hosts, words(host, "label:"), words(path, "path:"), words(query, "query:")))
    return F.when(after_scheme(url) == "", F.array().cast("array<string>")).otherwise(items)


def mine_items(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT,
               min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> tuple[DataFrame, DataFrame]:
    """items (sorted), confidence, support, lift of the rules that say bad, and the tokens that
    each item stands for (token, item: the smallest of them).

    A page is bad if its label says low quality or toxic; labels join on the page's id."""
    spark = pages.sparkSession
    checkpoint_dir(spark)
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(bad, F.lit(False))).alias("bad"))
    labelled = pages.select("page_id", "url").join(known, F.col("page_id") == F.col("doc_id")).select(tokens_of(F.col("url")).alias("tokens"), "bad").where(F.size("tokens") > 0)
    baskets = stage_table(labelled.select(F.monotonically_increasing_id().alias("row"), F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")), "url-baskets")
    n = baskets.count()
    empty = spark.createDataFrame([], "items array<string>, confidence double, support double, lift double")
    if n == 0:
        return empty, spark.createDataFrame([], "token string, item string")
    least = max(min_support, min_count / n)
    # Only tokens that are often enough in bad urls can be in a rule; others would only grow the tree.
    often = baskets.where(F.array_contains("items", BAD)).select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= F.ceil(F.lit(least * n)))
    useful = stage_table(often.select("item"), "url-tokens")
    held = stage_table(baskets.select("row", F.explode("items").alias("token")).join(useful.withColumnRenamed("item", "token"), "token"), "url-held")
    # the set of urls a token occurs in, as their number and two hashes
    seen = held.where(F.col("token") != BAD).groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64(F.lit(1), "row") % 1_000_000_007).alias("s"))
    items = seen.groupBy("k", "x", "s").agg(F.min("token").alias("item"))
    names = stage_table(seen.join(items, ["k", "x", "s"]).select("token", "item"), "url-items")
    slim = held.join(names, "token", "left").groupBy("row").agg(F.collect_set(F.coalesce("item", F.lit(BAD))).alias("items"))
    slim = stage_table(slim.select("items"), "url-slim")
    m, n_bad = slim.count(), baskets.where(F.array_contains("items", BAD)).count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least * n / max(1, m)), minConfidence=min_confidence).fit(slim)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD) & (F.size("antecedent") <= MAX_TOKENS))
    # urls without a useful token are no transactions of the miner: its confidence doesn't need them, lift and support do
    lift = F.col("confidence") * F.lit(float(n)) / F.lit(float(max(1, n_bad)))
    rules = rules.select(F.array_sort("antecedent").alias("items"), "confidence", (F.col("support") * F.lit(float(m)) / F.lit(float(n))).alias("support"), lift.alias("lift"))
    rules = stage_table(rules.where(F.col("lift") >= min_lift), "url-rules")
    # A rule goes if one with a proper part of its tokens is at least as certain: rules are found by each part they might have.
    part = rules.select(F.col("items").alias("whole"), F.col("confidence").alias("c"), F.explode(proper_parts(F.col("items"))).alias("items"))
    covered = part.join(rules.select("items", "confidence"), "items").where(F.col("confidence") >= F.col("c")).select(F.col("whole").alias("items")).distinct()
    return rules.join(covered, "items", "left_anti"), names


def mine_rules(pages: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rules of :func:`mine_items` written out: one for every choice of a token per item."""
    rules, names = mine_items(pages, labels, **bounds)
    rules = rules.withColumn("rule", F.monotonically_increasing_id())
    rules = stage_table(rules, "url-rules-numbered")
    of = rules.select("rule", F.explode("items").alias("item")).join(names, "item").groupBy("rule", "item").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    lists = of.groupBy("rule").agg(F.collect_list("tokens").alias("lists"))  # at most MAX_TOKENS
    one = F.array(F.array().cast("array<string>"))
    choices = F.aggregate("lists", one, lambda done, more: F.flatten(F.transform(done, lambda d: F.transform(more, lambda t: F.array_append(d, t)))))
    return rules.join(lists, "rule").select(F.explode(choices).alias("items"), "confidence", "support", "lift").withColumn("items", F.array_sort("items"))


def proper_parts(items: Column) -> Column:
    """Sorted proper, non-empty parts of up to MAX_TOKENS items."""
    bits = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size(items)) - 2).cast("int"))
    parts = F.transform(bits, lambda b: F.filter(items, lambda x, k: F.floor(b / F.pow(F.lit(2), k)) % 2 == 1))
    return F.when(F.size(items) > 1, parts).otherwise(F.array().cast("array<array<string>>"))


def hand_verdicts(urls: DataFrame, hand_rules: list[tuple[str, str, str]]) -> DataFrame:
    """url, rule, hand: the longest hand-written rule that fits (ties: the larger string, then block)."""
    spark = urls.sparkSession
    rules = spark.createDataFrame([(v, h, p) for v, h, p in hand_rules], "hand string, h string, p string")
    at = urls.select("url", "host", "path", F.explode(host_suffixes(F.col("host"))).alias("h")).join(rules, "h").where(F.startswith("path", "p"))
    rule = F.concat("h", "p")
    best = at.groupBy("url").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), F.col("hand"))).alias("best"))
    return best.select("url", "best.rule", "best.hand")


def mined_verdicts(urls: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """url, matched (the rule's items), confidence of the most certain rule that fits."""
    used = rules.select(F.explode("items").alias("item")).distinct()
    known = stage_table(names.join(used, "item"), "url-used")
    held = urls.select("url", F.explode("tokens").alias("token")).join(known, "token").select("url", "item").distinct()
    tokens = stage_table(held, "url-tokens-held")
    whole = tokens.groupBy("url").agg(F.collect_list("item").alias("tokens"))  # of one url
    counts = tokens.groupBy("item").agg(F.count(F.lit(1)).alias("k"))
    rarest = (rules.select("items", "confidence", F.explode("items").alias("item")).join(counts, "item")
              .groupBy("items", "confidence").agg(F.min(F.struct("k", "item")).alias("low")).select("items", "confidence", F.col("low.item").alias("item")))
    index = stage_table(rarest, "url-index")
    met = tokens.join(index, "item").join(whole, "url").where(F.size(F.array_except("items", "tokens")) == 0)
    best = met.groupBy("url").agg(F.max(F.struct("confidence", F.array_join("items", " ").alias("matched"))).alias("best"))
    return best.select("url", "best.matched", "best.confidence")


def filter_urls(pages: DataFrame, labels: DataFrame, hand_rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule (hand-written), verdict, matched (mined tokens), confidence."""
    hand_rules = HAND_RULES if hand_rules is None else hand_rules
    mined, names = mine_items(pages, labels)
    mined = stage_table(mined, "url-mined")
    url = F.col("url")
    urls = stage_table(pages.where(url.isNotNull()).select("url").distinct().select("url", host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens")), "urls")
    told = stage_table(urls.select("url").join(hand_verdicts(urls, hand_rules), "url", "left").join(mined_verdicts(urls, mined, names), "url", "left"), "url-verdicts").withColumnRenamed("url", "__url")
    out = pages.select("page_id", "url").join(told, F.col("url") == F.col("__url"), "left")
    verdict = F.coalesce("hand", F.when(F.col("matched").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "rule", verdict.alias("verdict"), "matched", "confidence")

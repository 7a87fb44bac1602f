"""URL filters: a fixed rule list, and association rules for what it leaves open; DataFrame functions only.

Spark's FP-growth mines combinations of URL tokens together with a label. Tokens that the same labelled
URLs hold (by count and 128 bits of a hash of the set of URLs) make one item, since they tell the same:
words that a site repeats in all its URLs so don't multiply combinations. A combination becomes a
rule for its label if enough labelled URLs support it and enough of those that hold it have the
label, unless a part of it does as well. Rules stand in an inverted index under the tokens of their
rarest item: a URL meets only rules of which it holds such a token, and one fits if the URL holds a
token of each of its items. The rule of highest confidence, then support, then one that blocks, then
the last antecedent in order, gives the verdict; without one it is allow. Tokens that every labelled
URL holds are left out.

Labels: pages of the labels table (a URL's path ends in the number of the document it shows) are to
block if toxic or of quality 0, else to allow; and a host with a word of SEEDS is to block.

Defined results: a null or empty URL, or one without ://, has empty host and path and the verdict
allow; repeated rows get one result each; an empty table gives no rows; without labels the seeds
alone teach; other columns are ignored, whatever their names. A very long URL has as many tokens as it
has words; of them those that SUPPORT labelled URLs hold are mined, the others cost one row each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import near, table, written

#: Fixed by the contract: verdict, rule (host, then path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words of a host that mark it as one to block.
SEEDS = "ad adult ads adserver bet bets betting casino gambling malware phishing pills poker porn sex slots spam tracker tracking viagra warez xxx".split()
SUPPORT, COUNT, CONFIDENCE = 0.0005, 5, 0.8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule whose host is this one or above it, and whose path begins this one; a struct (rule, verdict) or null."""
    found = []
    for verdict, rule in rules:
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found.append((len(rule), F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))))
    return F.coalesce(*[c for _, c in sorted(found, key=lambda x: -x[0])])


def tokens(url: Column) -> Column:
    """A URL's tokens: words of the host, its last two labels, words of the path, file kind, names in the query. Numbers are none."""
    host, path = host_of(url), path_of(url)
    tagged = lambda tag, words: F.transform(F.filter(words, lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit(tag), F.lower(x)))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    parts = [
        tagged("host:", F.split(host, "[.-]")), tagged("site:", F.array(F.substring_index(host, ".", -2))), tagged("path:", F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), "[/._-]")),
        tagged("kind:", F.array(F.regexp_extract(path, r"\.([A-Za-z][A-Za-z0-9]{0,4})$", 1))), tagged("query:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
    ]
    return F.coalesce(F.array_distinct(F.concat(*parts)), F.array().cast("array<string>"))


def label_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and label (block or allow) of the pages that have one."""
    number = F.regexp_extract(path_of(F.col("url")), r"([0-9]+)[^0-9]*$", 1)
    own = pages.where(F.col("url").isNotNull()).select("url", number.alias("number")).select("url", F.expr("try_cast(number as bigint)").alias("doc_id"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).cast("int")).alias("bad"))
    seeded = F.exists(F.split(host_of(F.col("url")), "[.-]"), lambda x: x.isin(SEEDS))
    label = F.when(seeded | (F.col("bad") == 1), "block").when(F.col("bad") == 0, "allow")
    return own.join(known, "doc_id", "left").select("url", label.alias("label")).where(F.col("label").isNotNull())


def items_of(rows: DataFrame, least: int, total: int) -> DataFrame:
    """item, token, held: tokens that at least ``least`` rows hold, and not all; those in the same rows share an item (the first of them).

    There are at most total / least times as many as a row has tokens.
    """
    each = rows.select("row", F.explode("tokens").alias("token"))
    mark = lambda k: F.bit_xor(F.xxhash64("row", F.lit(k)))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("held"), mark(1).alias("m1"), mark(2).alias("m2"))
    counts = written(counts.where((F.col("held") >= least) & (F.col("held") < total)), "url-tokens")
    same = ["held", "m1", "m2"]
    first = counts.groupBy(*same).agg(F.min("token").alias("item"))
    return written(counts.join(first, same).select("item", "token", "held"), "url-items")


RULES_SCHEMA = "antecedent array<array<string>>, label string, freq long, confidence double, key array<string>"


def mine(labelled: DataFrame, support: float = SUPPORT, count: int = COUNT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules: antecedent (its items, each the sorted tokens that it stands for), label, freq, confidence, key (its rarest item's tokens)."""
    from pyspark.ml.fpm import FPGrowth

    rows = labelled.select(tokens(F.col("url")).alias("tokens"), F.concat(F.lit("label="), "label").alias("label")).where(F.size("tokens") > 0)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "url-labels")
    total = rows.count()
    if not total:
        return labelled.sparkSession.createDataFrame([], RULES_SCHEMA)
    least = math.ceil(max(support * total, count - 0.5))
    items = items_of(rows, least, total)
    held = rows.select("row", F.explode("tokens").alias("token")).join(near(items.select("item", "token")), "token")
    own = held.groupBy("row").agg(F.collect_set("item").alias("items")).join(rows.select("row", "label"), "row")
    baskets = own.select(F.concat("items", F.array("label")).alias("items"))
    # half below a whole number, since Spark rounds the least count up
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / total), minConfidence=confidence).fit(baskets).freqItemsets
    sets = written(found.select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq")), "url-itemsets")
    is_label = lambda x: x.startswith("label=")
    bare = F.filter("items", lambda x: ~is_label(x))
    marked = sets.where(F.exists("items", is_label) & (F.size("items") > 1)).select(bare.alias("antecedent"), F.filter("items", is_label)[0].alias("label"), "freq")
    plain = sets.where(~F.exists("items", is_label)).select(F.col("items").alias("antecedent"), F.col("freq").alias("held"))
    rules = marked.join(plain, "antecedent").select("antecedent", F.substring("label", 7, 100).alias("label"), "freq", (F.col("freq") / F.col("held")).alias("confidence"))
    rules = rules.where(F.col("confidence") >= confidence)
    # a rule goes if leaving out one item makes it no less sure
    smaller = rules.where(F.size("antecedent") > 1).select("antecedent", "label", F.col("confidence").alias("own"), F.explode("antecedent").alias("gone"))
    smaller = smaller.select("antecedent", "label", "own", F.array_remove("antecedent", F.col("gone")).alias("part"))
    parts = rules.select(F.col("antecedent").alias("part"), "label", F.col("confidence").alias("theirs"))
    spare = smaller.join(parts, ["part", "label"]).where(F.col("theirs") >= F.col("own")).select("antecedent", "label").distinct()
    rules = rules.join(spare, ["antecedent", "label"], "left_anti")
    # items are spelled out as their tokens
    classes = items.groupBy("item").agg(F.array_sort(F.collect_list("token")).alias("tokens"), F.first("held").alias("held"))
    spelled = rules.select("antecedent", "label", F.explode("antecedent").alias("item")).join(near(written(classes, "url-classes")), "item")
    spelled = spelled.groupBy("antecedent", "label").agg(F.array_sort(F.collect_list("tokens")).alias("spelled"), F.min(F.struct("held", "tokens"))["tokens"].alias("key"))
    return written(rules.join(spelled, ["antecedent", "label"]).select(F.col("spelled").alias("antecedent"), "label", "freq", "confidence", "key"), "url-rules")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, verdict, antecedent, confidence of each distinct URL that a rule fits."""
    held = urls.select("url").where(F.col("url").isNotNull()).distinct().withColumn("tokens", tokens(F.col("url")))
    index = rules.withColumn("key", F.explode("key"))
    met = held.select("url", "tokens", F.explode("tokens").alias("key")).join(index, "key").where(F.forall("antecedent", lambda x: F.arrays_overlap("tokens", x)))
    best = F.max(F.struct("confidence", "freq", (F.col("label") == "block").alias("blocks"), "antecedent", "label"))
    chosen = met.groupBy("url").agg(best.alias("best"))
    return chosen.select("url", F.col("best.label").alias("verdict"), F.col("best.antecedent").alias("antecedent"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, antecedent (of the mined rule that decided, if one did)."""
    read = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    read = read.withColumn("fixed", rule_of(F.col("host"), F.col("path"), rules))
    mined = mine(label_pages(pages.select("url"), labels))
    found = match(read.where(F.col("fixed").isNull()), mined).select("url", F.col("verdict").alias("mined"), "antecedent")
    open_ = F.col("fixed").isNull()
    return read.join(found, "url", "left").select("page_id", "url", "host", "path", F.col("fixed.rule").alias("rule"), F.when(open_, F.coalesce("mined", F.lit("allow"))).otherwise(F.col("fixed.verdict")).alias("verdict"), F.when(open_, F.col("antecedent")).alias("antecedent"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The same in SQL, counting all combinations of each labelled URL's tokens."""
    tagged = lambda tag, words: f"['{tag}' || lower(x) FOR x IN {words} IF x <> '' AND NOT regexp_matches(x, '^[0-9]+$')]"
    parts = " || ".join([
        tagged("host:", "regexp_split_to_array(host, '[.-]')"), tagged("site:", r"[CASE WHEN contains(host, '.') THEN regexp_extract(host, '[^.]*\.[^.]*$') ELSE host END]"),
        tagged("path:", r"regexp_split_to_array(regexp_replace(path, '\.[A-Za-z0-9]{1,5}$', ''), '[/._-]')"), tagged("kind:", r"[regexp_extract(path, '\.([A-Za-z][A-Za-z0-9]{0,4})$', 1)]"),
        tagged("query:", r"[split_part(y, '=', 1) FOR y IN string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&')]"),
    ])
    fits = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN {{'rule': '{rule}', 'verdict': '{verdict}'}}")
    seeds = ", ".join(f"'{x}'" for x in SEEDS)
    return rf"""
WITH u AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), t AS (
  SELECT *, list_sort(list_distinct(coalesce({parts}, []))) AS tokens, CASE {" ".join(fits)} END AS fixed FROM u
), k AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), y AS (
  SELECT tokens, CASE WHEN len([x FOR x IN regexp_split_to_array(host, '[.-]') IF x IN ({seeds})]) > 0 OR bad = 1 THEN 'block' WHEN bad = 0 THEN 'allow' END AS label
  FROM t LEFT JOIN k ON k.doc_id = TRY_CAST(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) WHERE url IS NOT NULL
), m AS (
  SELECT row_number() OVER () AS row, * FROM y WHERE label IS NOT NULL AND len(tokens) > 0
), n AS (
  SELECT count(*) AS n FROM m
), z AS (
  SELECT token FROM (SELECT unnest(tokens) AS token FROM m) GROUP BY token HAVING count(*) = (SELECT n FROM n)
), o AS (
  SELECT row, any_value(label) AS label, list(token ORDER BY token) AS items FROM (SELECT row, label, unnest(tokens) AS token FROM m) WHERE token NOT IN (SELECT token FROM z) GROUP BY row
), e AS (
  SELECT label, items, unnest(range(1, 1 << len(items))) AS mask FROM o
), s AS (
  SELECT label, [items[i] FOR i IN range(1, len(items) + 1) IF (mask >> (i - 1)) & 1 = 1] AS part FROM e
), h AS (
  SELECT part, count(*) AS held FROM s GROUP BY part
), r AS (
  SELECT s.part, s.label, count(*) AS freq, count(*) / any_value(h.held) AS confidence FROM s JOIN h ON h.part = s.part GROUP BY s.part, s.label
  HAVING count(*) >= ceil(greatest({SUPPORT} * (SELECT n FROM n), {COUNT} - 0.5)) AND count(*) / any_value(h.held) >= {CONFIDENCE}
), g AS (
  SELECT part, label, confidence, [x FOR x IN part IF x <> gone] AS smaller FROM (SELECT *, unnest(part) AS gone FROM r WHERE len(part) > 1)
), f AS (
  SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM g JOIN r b ON b.part = g.smaller AND b.label = g.label AND b.confidence >= g.confidence WHERE g.part = r.part AND g.label = r.label)
), v AS (
  SELECT t.url, arg_max(f.label, {{'c': f.confidence, 'n': f.freq, 'b': f.label = 'block'}}) AS label FROM (SELECT DISTINCT url, tokens FROM t WHERE fixed IS NULL) t JOIN f ON list_has_all(t.tokens, f.part) GROUP BY t.url
)
SELECT t.page_id, t.host, t.path, t.fixed.rule AS rule, coalesce(t.fixed.verdict, v.label, 'allow') AS verdict FROM t LEFT JOIN v ON v.url = t.url
"""


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLES = {"op7_url_filter": _sql()}

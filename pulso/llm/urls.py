"""URL filter: fixed prefix rules, and association rules mined by FP-growth.

Every url is cut into host, path and tokens (host labels, path parts, query keys;
digits only become ``#``). Fixed rules ``(verdict, host, path)`` fit a host and its
subdomains where the path starts with the rule's; the longest wins.

Urls judged by a fixed rule are the labelled examples: Spark's FP-growth mines the
token combinations that stand together with a verdict; rules below the support or
confidence bound are pruned, and so is a rule that a shorter one with the same
verdict and at least its confidence implies. The remaining rules are kept in an
inverted index under their rarest token. A url that no fixed rule fits looks its
tokens up, the whole combination is checked, and the most confident rule decides
(ties: more tokens, more support, then block); without any, ``default``.

Scale: verdicts are found per distinct url (combined map-side, so a hot url is
looked up once) and joined back, the index joined by size as Spark sees it. Mined
rules are few by the support bound, but nothing is collected.

Defined cases: a null url, or one without ``://``, has empty host and path and no
tokens, and gets the default. Repeated page ids keep their own rows. Without any
labelled url no rule is mined. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: The query's fixed rules: verdict, host, path prefix.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; '' without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens ``h:`` host label, ``p:`` path part, ``q:`` query key."""
    def parts(text: Column, cut: str, mark: str) -> Column:
        named = F.filter(F.split(text, cut), lambda x: x != "")
        return F.transform(named, lambda x: F.concat(
            F.lit(mark), F.when(x.rlike("^[0-9]+$"), "#").otherwise(x)))

    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    return F.array_distinct(F.concat(
        parts(host_of(url), r"\.", "h:"),
        parts(F.translate(path_of(url), _UPPER, _LOWER), r"[^0-9a-z%_\x80-\x{10FFFF}-]+", "p:"),
        F.transform(F.filter(keys, lambda x: x != ""), lambda x: F.concat(F.lit("q:"), x))))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host + path`` and its verdict; null if none fits."""
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT,
         min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Association rules ``tokens -> verdict`` of ``labelled`` (``tokens, verdict``):
    ``rule, tokens, verdict, confidence, support``, without those a shorter one implies."""
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("y:"), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    mined = (model.associationRules
             .where(F.element_at("consequent", 1).startswith("y:")
                    & ~F.exists("antecedent", lambda x: x.startswith("y:")))
             .select(F.array_sort("antecedent").alias("tokens"),
                     F.substring(F.element_at("consequent", 1), 3, 99).alias("verdict"),
                     "confidence", "support"))
    mined = written(mined.withColumn("rule", F.array_join("tokens", " ")), "url-rules")
    # a rule's subsets one token shorter, looked up among the rules of its verdict
    less = (mined.where(F.size("tokens") > 1)
            .select("rule", "verdict", F.col("confidence").alias("own"), "tokens",
                    F.explode("tokens").alias("out"))
            .select("rule", "verdict", "own", F.array_join(F.array_remove("tokens", F.col("out")), " ").alias("part")))
    shorter = mined.select(F.col("rule").alias("part"), "verdict", "confidence")
    implied = (less.join(shorter, ["part", "verdict"]).where("confidence >= own")
               .select("rule", "verdict").distinct())
    return mined.join(implied, ["rule", "verdict"], "left_anti")


def index(rules: DataFrame) -> DataFrame:
    """Each rule under the token that fewest rules hold: ``token, tokens, score``."""
    each = rules.select("*", F.explode("tokens").alias("token"))
    spread = each.groupBy("token").agg(F.count("*").alias("n"))
    score = F.struct("confidence", F.size("tokens").alias("size"), "support", "verdict", "rule")
    return (each.join(spread, "token").groupBy("rule", "verdict")
            .agg(F.min_by("token", F.struct("n", "token")).alias("token"),
                 F.first("tokens").alias("tokens"), F.first(score).alias("score"))
            .select("token", "tokens", "score"))


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT,
          min_confidence: float = MIN_CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rule, confidence`` for every row."""
    url = F.col("url")
    parsed = pages.select("page_id", url.cast("string").alias("url")).withColumns(
        {"host": host_of(url), "path": path_of(url)})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": name, "verdict": verdict})
    labelled = parsed.where("rule IS NOT NULL").select(tokens_of(url).alias("tokens"), "verdict")
    by_token = written(index(mine(labelled, min_support, min_confidence)), "url-index")

    open_urls = parsed.where("rule IS NULL AND host <> ''").select("url").distinct()
    looked_up = (open_urls.withColumn("own", tokens_of(url)).withColumn("token", F.explode("own"))
                 .join(by_token, "token")
                 .where(F.size(F.array_except("tokens", "own")) == 0)
                 .groupBy("url").agg(F.max("score").alias("score")))
    looked_up = written(looked_up, "url-verdicts")
    rest = parsed.where("rule IS NULL").drop("verdict").join(looked_up, "url", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("score.verdict", F.lit(default)).alias("verdict"),
        F.col("score.rule").alias("mined_rule"), F.col("score.confidence").alias("confidence"))
    fixed = parsed.where("rule IS NOT NULL").select(
        "page_id", "host", "path", "rule", "verdict",
        F.lit(None).cast("string").alias("mined_rule"), F.lit(None).cast("double").alias("confidence"))
    return fixed.unionByName(rest)


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")

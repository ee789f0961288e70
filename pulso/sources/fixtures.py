"""Views over the driver's test tables that play the reference's tables.

Each view has a Spark builder and the equivalent DuckDB SQL (a CTE body) so
that ``oracle_sql()`` computes on exactly the same rows. The mapping is
documented in FIXTURES.md section B. Timestamps stay ``timestamp_ntz`` (wall
clock, no session-zone dependence); days are ``date``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- posts
def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored posts (id, createdAt, date, author, 3 scores, 4 counts, processed)."""
    return posts_of_events(table(spark, sf_dir, "events"))


def posts_of_events(e: DataFrame, ts_type: str = "timestamp_ntz") -> DataFrame:
    """The posts view over an events frame (batch or streaming)."""
    eid = F.col("event_id")
    return e.select(
        eid.cast("string").alias("id"),
        F.col("ts").cast(ts_type).alias("createdAt"),
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("author"),
        ((eid % 10).cast("double") / 10.0).alias("score_positive"),
        (((eid * 3) % 7).cast("double") / 10.0).alias("score_negative"),
        (((eid * 5) % 9).cast("double") / 10.0).alias("score_neutral"),
        (eid % 17).alias("retweetCount"),
        (eid % 5).alias("replyCount"),
        F.floor("value").cast("long").alias("likeCount"),
        F.get_json_object("props", "$.k").cast("long").alias("quoteCount"),
        F.when(eid % 11 == 0, F.lit(None).cast("boolean"))
         .otherwise(eid % 3 == 0).alias("processed"),
    )


SQL_POSTS = """
SELECT CAST(event_id AS VARCHAR) AS id,
       CAST(ts AS TIMESTAMP) AS createdAt,
       CAST(ts AS DATE) AS date,
       event_type AS author,
       CAST(event_id % 10 AS DOUBLE) / 10.0 AS score_positive,
       CAST((event_id * 3) % 7 AS DOUBLE) / 10.0 AS score_negative,
       CAST((event_id * 5) % 9 AS DOUBLE) / 10.0 AS score_neutral,
       CAST(event_id % 17 AS BIGINT) AS retweetCount,
       CAST(event_id % 5 AS BIGINT) AS replyCount,
       CAST(floor(value) AS BIGINT) AS likeCount,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS quoteCount,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 3 = 0 END AS processed
FROM events
"""


# ---------------------------------------------------------------- polls
def polls(spark: SparkSession, sf_dir: str, posts_df: DataFrame | None = None) -> DataFrame:
    """Weekly polls dated on the week-ending Sunday, derived from ``posts``.

    approval = purchase / (purchase + error) over the week's posts, rounded to 4.
    Weeks whose Sunday lies after the last post day are dropped.
    """
    from pyspark.sql import Window

    p = posts_df if posts_df is not None else posts(spark, sf_dir)
    weekly = (
        p.where(F.col("date").isNotNull())
        .groupBy(F.expr("date_add(date, 6 - weekday(date))").alias("date"))
        .agg(F.count_if(F.col("author") == "purchase").alias("n_p"),
             F.count_if(F.col("author") == "error").alias("n_e"),
             F.max("date").alias("last_day"))
    )
    # one row per week: an un-partitioned window over weeks is bounded
    last = F.max("last_day").over(Window.partitionBy())
    tot = (F.col("n_p") + F.col("n_e")).cast("double")
    return (
        weekly.withColumn("_last", last).where(F.col("date") <= F.col("_last"))
        .select("date",
                F.round(F.try_divide(F.col("n_p").cast("double"), tot), 4).alias("aprobacion"),
                F.round(F.try_divide(F.col("n_e").cast("double"), tot), 4).alias("desaprobacion"))
    )


SQL_POLLS = """
SELECT date, aprobacion, desaprobacion FROM (
  SELECT CAST(date + CAST(7 - isodow(date) AS INTEGER) AS DATE) AS date,
         round(CAST(count(*) FILTER (WHERE author = 'purchase') AS DOUBLE)
               / nullif(count(*) FILTER (WHERE author IN ('purchase', 'error')), 0), 4) AS aprobacion,
         round(CAST(count(*) FILTER (WHERE author = 'error') AS DOUBLE)
               / nullif(count(*) FILTER (WHERE author IN ('purchase', 'error')), 0), 4) AS desaprobacion
  FROM posts WHERE date IS NOT NULL
  GROUP BY 1
) w WHERE date <= (SELECT max(date) FROM posts)
"""


# ---------------------------------------------------------------- text posts
def text_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split into lines; every 5th line gets a mention, hashtag and URL."""
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    lines = text_posts_of(docs, pages, pages.count())  # parquet footer count, one number
    # A test table is one row group, so one split, and its lines would be cleaned by
    # one core: spread them. A table in enough splits (any large one) is left as it is.
    cores = spark.sparkContext.defaultParallelism
    return lines.repartition(2 * cores) if docs.rdd.getNumPartitions() < cores else lines


def text_posts_of(docs: DataFrame, pages: DataFrame, n_pages: int) -> DataFrame:
    """The text-posts view over a documents frame (batch or streaming)."""
    lines = docs.select(
        "doc_id", "lang", "source",
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    ).withColumn("line_no", (F.col("pos") + 1).cast("long"))
    marked = (F.col("line_no") % 5) == 0
    own = F.col("page_id") == F.col("doc_id") % F.lit(max(n_pages, 1))
    if docs.isStreaming:
        joined = lines.join(pages, marked & own, "left")
    else:           # only the lines that get a URL are sent to the pages
        joined = (lines.where(marked).join(pages, own, "left")
                  .unionByName(lines.where(~marked), allowMissingColumns=True))
    return joined.select(
        F.concat_ws("-", F.col("doc_id").cast("string"),
                    F.col("line_no").cast("string")).alias("id"),
        F.when(marked, F.concat(F.col("line"), F.lit(" @user_1 #tema "),
                                F.coalesce(F.col("url"), F.lit(""))))
         .otherwise(F.col("line")).alias("text"),
        "lang",
        F.col("source").alias("author"),
        F.expr("timestampadd(HOUR, (doc_id * 37 + line_no) % 720, "
               "TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("createdAt"),
        ((F.col("doc_id") * 13 + F.col("line_no")) % 101).alias("likeCount"),
        "doc_id", "line_no",
    )


SQL_TEXT_POSTS = """
SELECT CAST(l.doc_id AS VARCHAR) || '-' || CAST(l.line_no AS VARCHAR) AS id,
       CASE WHEN l.line_no % 5 = 0
            THEN l.line || ' @user_1 #tema ' || coalesce(p.url, '')
            ELSE l.line END AS text,
       l.lang AS lang,
       l.source AS author,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((l.doc_id * 37 + l.line_no) % 720 AS BIGINT)) AS createdAt,
       CAST((l.doc_id * 13 + l.line_no) % 101 AS BIGINT) AS likeCount,
       l.doc_id AS doc_id, l.line_no AS line_no
FROM (
  SELECT doc_id, lang, source,
         unnest(string_split(text, chr(10))) AS line,
         CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line_no
  FROM documents
) l
LEFT JOIN pages p
  ON l.line_no % 5 = 0 AND p.page_id = l.doc_id % (SELECT count(*) FROM pages)
"""


# ---------------------------------------------------------------- lemmas
def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lemma table that grows with the texts: every word of five letters or more in
    ``documents``, without an ending (token, lemma)."""
    words = table(spark, sf_dir, "documents").select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0))).alias("token"))
    # counted, not only distinct: the optimizer takes a distinct away below an aggregate that
    # duplicates can't change, which then sorts every occurrence
    words = words.where(F.char_length("token") >= 5).groupBy("token").count().where("count > 0")
    return words.select(
        "token", F.regexp_replace("token", LEMMA_ENDINGS, "").alias("lemma"))


LEMMA_ENDINGS = "(en|er|es|ing|s|e)$"

SQL_LEMMAS = f"""
SELECT token, regexp_replace(token, '{LEMMA_ENDINGS}', '') AS lemma FROM (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token FROM documents) t
WHERE length(token) >= 5
"""


# ---------------------------------------------------------------- replies
def conversation_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as posts; turn 0 is the parent, later turns reply."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn", "role", "text",
        F.expr("timestampadd(MINUTE, turn, timestampadd(HOUR, conv_id, "
               "TIMESTAMP_NTZ'2024-01-01 00:00:00'))").alias("createdAt"),
    )


SQL_CONVERSATION_POSTS = """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
       conv_id, turn, role, text,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS createdAt
FROM conversations
"""


# ---------------------------------------------------------------- long daily series
def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order day: mean total price, share of finished orders, count."""
    o = table(spark, sf_dir, "orders")
    return (
        o.where(F.col("o_orderdate").isNotNull())
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(F.avg("o_totalprice").alias("avg_price"),
             F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("share_f"),
             F.count(F.lit(1)).alias("n_orders"))
    )


SQL_DAILY_ORDERS = """
SELECT CAST(o_orderdate AS DATE) AS date,
       avg(o_totalprice) AS avg_price,
       avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS share_f,
       count(*) AS n_orders
FROM orders WHERE o_orderdate IS NOT NULL
GROUP BY 1
"""


# ---------------------------------------------------------------- literal parameters
# Topic seeds for the test tables (seed id, keyword), chosen from
# frequent words of each language; seed 5 has no keyword.
FIXTURE_SEEDS = (
    (0, "that"), (0, "with"),
    (1, "der"), (1, "die"),
    (2, "les"), (2, "des"),
    (3, "los"), (3, "las"),
    (4, "for"), (4, "was"),
)
FIXTURE_N_SEEDS = 6
FIXTURE_TOPIC_LABELS = (
    (0, "english_a"), (1, "german"), (2, "french"), (3, "spanish"),
    (4, "english_b"), (-1, "Otros"),
)

# A small sentiment lexicon, word -> (negative, neutral, positive) logits.
FIXTURE_LEXICON = (
    ("the", 0.1, 0.6, 0.2), ("and", 0.0, 0.3, 0.5), ("with", -0.2, 0.1, 0.9),
    ("der", 0.8, 0.2, -0.1), ("die", 0.7, 0.1, 0.0), ("und", 0.1, 0.4, 0.3),
    ("les", 0.2, 0.2, 0.6), ("des", 0.5, 0.3, 0.1), ("la", 0.0, 0.5, 0.4),
    ("los", 0.9, 0.0, 0.2), ("las", 0.3, 0.3, 0.3), ("de", 0.4, 0.5, 0.1),
)


def _inline(spark: SparkSession, rows, types: str) -> DataFrame:
    """A literal table whose size the optimizer knows (rows handed over from Python have none)."""
    fields = [t.strip().split(" ") for t in types.split(",")]
    cols = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in fields)
    return spark.sql(f"SELECT {cols} FROM {sql_values(rows, [n for n, _ in fields])}")


def seeds(spark: SparkSession) -> DataFrame:
    return _inline(spark, FIXTURE_SEEDS, "seed_id int, keyword string")


def topic_labels(spark: SparkSession) -> DataFrame:
    return _inline(spark, FIXTURE_TOPIC_LABELS, "topic_id int, label string")


def lexicon(spark: SparkSession) -> DataFrame:
    return _inline(spark, FIXTURE_LEXICON, "word string, neg double, neu double, pos double")


def sql_values(rows, names) -> str:
    """A ``(VALUES ...) t(cols)`` literal for the oracle strings."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) t({', '.join(names)})"


# ---------------------------------------------------------------- predictions
def predictions(spark: SparkSession, sf_dir: str, posts_df: DataFrame | None = None) -> DataFrame:
    """Stand-in prediction table: one row per post day, the expanded poll
    values played as predictions, and a stale metric column that a metrics
    re-run must replace."""
    from ..operators.polls import poll_calendar

    p = posts_df if posts_df is not None else posts(spark, sf_dir)
    days = p.where(F.col("date").isNotNull()).select("date").distinct()
    cal = poll_calendar(polls(spark, sf_dir, p))
    return days.join(cal, "date", "left").select(
        "date", F.col("aprobacion").alias("prediccion_aprobacion"),
        F.col("desaprobacion").alias("prediccion_desaprobacion"),
        F.lit(-1.0).alias("indice_negatividad"))


SQL_PREDICTIONS = """
SELECT d.date AS date, c.aprobacion AS prediccion_aprobacion,
       c.desaprobacion AS prediccion_desaprobacion, -1.0 AS indice_negatividad
FROM (SELECT DISTINCT date FROM posts WHERE date IS NOT NULL) d
LEFT JOIN calp c USING (date)
"""


# ---------------------------------------------------------------- orders as posts
def order_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders played as posts of five authors (the order priority), for the
    per-author month harvest."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"),
                    F.col("o_orderpriority").alias("author"),
                    F.col("o_orderdate").cast("timestamp_ntz").alias("createdAt"),
                    F.col("o_totalprice").alias("likeCount"))


SQL_ORDER_POSTS = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS author,
       CAST(o_orderdate AS TIMESTAMP) AS createdAt, o_totalprice AS likeCount
FROM orders
"""

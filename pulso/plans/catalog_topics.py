"""Catalogue: vectors (X12, A2), topics (M7-M9, A7-A10) and the lexicon
sentiment scorer (M1, X10, X11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sentiment import lexicon_sentiment, softmax_label
from ..functions.text import TOKEN
from ..operators import clustering as CL
from ..operators import terms as TM
from ..operators import topics as TP
from ..operators import vectors as V
from ..session import reliable_checkpoint, scratch_path
from ..sources import fixtures as fx
from ..sources.tables import quality_table
from . import daily_run as DR
from . import sql_text as S
from .registry import r, r_col, register, rounded, with_ctes

EMB_DIM = 64


def _round_array(c, digits=5):
    return F.transform(F.col(c), lambda x: r_col(x, digits))


# ------------------------------------------------------------------ vectors

def _sql_token_occ() -> str:
    return (f"SELECT id, unnest(regexp_extract_all(text, {S.q(TOKEN)})[1:50]) AS token FROM cp")


SQL_EMBED = with_ctes(
    "SELECT id, list(" + r("v", 5) + " ORDER BY pos) AS embedding FROM ("
    "SELECT o.id, p.pos, avg(CAST(p.val AS DOUBLE)) AS v FROM occ o JOIN tv USING (token) "
    "JOIN (SELECT vec_id, unnest(embedding) AS val, unnest(range(0, len(embedding))) AS pos "
    "FROM embeddings) p ON p.vec_id = tv.vec_id GROUP BY o.id, p.pos) x GROUP BY id",
    tp=fx.SQL_TEXT_POSTS,
    cp="SELECT id, clean AS text FROM (SELECT id, " + S.clean_post_text("text")
       + " AS clean FROM tp) x WHERE clean IS NOT NULL",
    occ=_sql_token_occ(),
    tv="SELECT token, ('0x' || substr(md5(token), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) "
       "AS vec_id FROM (SELECT DISTINCT token FROM occ) t")


@register("embed_posts", SQL_EMBED, headline=True)
def q_embed_posts(spark, d):
    cp = TM.clean_posts(fx.text_posts(spark, d)).select("id", "text")
    out = V.embed_posts_hashed(cp, fx.table(spark, d, "embeddings"), EMB_DIM, max_tokens=50)
    return out.select("id", _round_array("embedding").alias("embedding"))


@register("mean_vector_long", with_ctes(
    "SELECT label, pos, " + r("avg(CAST(val AS DOUBLE))", 5) + " AS value FROM ("
    "SELECT label, unnest(embedding) AS val, unnest(range(0, len(embedding))) AS pos "
    "FROM embeddings) x GROUP BY label, pos"))
def q_mean_vector_long(spark, d):
    e = fx.table(spark, d, "embeddings")
    out = V.mean_vector_long(e, ["label"])
    return out.select("label", F.col("pos").cast("bigint").alias("pos"),
                      r_col(F.col("value"), 5).alias("value"))


@register("mean_vector", with_ctes(
    "SELECT label, list(" + r("v", 5) + " ORDER BY pos) AS embedding FROM ("
    "SELECT label, pos, avg(CAST(val AS DOUBLE)) AS v FROM (SELECT label, unnest(embedding) AS val, "
    "unnest(range(0, len(embedding))) AS pos FROM embeddings) x GROUP BY label, pos) y GROUP BY label"))
def q_mean_vector(spark, d):
    out = V.mean_vector(fx.table(spark, d, "embeddings"), ["label"])
    return out.select("label", _round_array("embedding").alias("embedding"))


CENTROID_THRESHOLD = 0.1

SQL_CENTROIDS = """
SELECT label AS topic_id, list(v ORDER BY pos) AS centroid FROM (
  SELECT label, pos, avg(CAST(val AS DOUBLE)) AS v FROM (
    SELECT label, unnest(embedding) AS val, unnest(range(0, len(embedding))) AS pos FROM embeddings
  ) x GROUP BY label, pos) y GROUP BY label
"""


@register("centroid_topics", with_ctes(
    f"SELECT vec_id, CASE WHEN sim >= {CENTROID_THRESHOLD} THEN topic_id ELSE -1 END::BIGINT AS topic, "
    f"{r('sim')} AS similarity FROM (SELECT e.vec_id, c.topic_id, "
    "list_dot_product(CAST(e.embedding AS DOUBLE[]), c.centroid) / "
    "(sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) "
    "* sqrt(list_dot_product(c.centroid, c.centroid))) AS sim, "
    "row_number() OVER (PARTITION BY e.vec_id ORDER BY list_dot_product(CAST(e.embedding AS DOUBLE[]), "
    "c.centroid) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) "
    "* sqrt(list_dot_product(c.centroid, c.centroid))) DESC, c.topic_id) AS rn "
    "FROM embeddings e, cents c) x WHERE rn = 1", cents=SQL_CENTROIDS))
def q_centroid_topics(spark, d):
    e = fx.table(spark, d, "embeddings")
    out = TP.centroid_topics(e, TP.fit_centroids(e), CENTROID_THRESHOLD)
    return rounded(out.select("vec_id", "topic", "similarity"))


@register("cluster_topics")
def q_cluster_topics(spark, d):
    e = fx.table(spark, d, "embeddings")
    return TP.cluster_topics(e, k=10).select("vec_id", "label", "cluster")


# ------------------------------------------------------------------ anchors and free topics

ANCHORED = 4            # labels that are anchors; the other rows are left to the free topics
FREE, ROUNDS, FREE_MIN = 2, 2, 20


def _sql_anchored() -> str:
    """Unit vectors ``u``, centres ``c0`` .. in long form: farthest rows one by one, then rounds."""
    sim = ("SELECT u.vec_id, c.topic_id, sum(u.x * c.x) AS s FROM u JOIN {c} c USING (pos) "
           "GROUP BY u.vec_id, c.topic_id")
    ctes = dict(
        e="SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS val, unnest(range(0, len(embedding))) AS pos FROM embeddings",
        u="SELECT vec_id, pos, val / sqrt(sum(val * val) OVER (PARTITION BY vec_id)) AS x FROM e",
        m=f"SELECT label AS topic_id, pos, avg(val) AS val FROM e WHERE label < {ANCHORED} GROUP BY label, pos",
        a="SELECT topic_id, pos, val / sqrt(sum(val * val) OVER (PARTITION BY topic_id)) AS x FROM m",
        c0="SELECT * FROM a")
    for k in range(FREE):
        ctes[f"f{k}"] = (f"SELECT vec_id FROM (SELECT vec_id, max(s) AS s FROM ({sim.format(c=f'c{k}')}) q "
                         "GROUP BY vec_id) z ORDER BY s, vec_id LIMIT 1")
        ctes[f"c{k + 1}"] = (f"SELECT * FROM c{k} UNION ALL SELECT {ANCHORED + k}, pos, x FROM u "
                             f"WHERE vec_id IN (SELECT vec_id FROM f{k})")
    for k in range(FREE, FREE + ROUNDS):
        ctes[f"n{k}"] = (f"SELECT vec_id, topic_id FROM ({sim.format(c=f'c{k}')}) q QUALIFY row_number() OVER "
                         "(PARTITION BY vec_id ORDER BY s DESC, topic_id) = 1")
        ctes[f"t{k}"] = (f"SELECT n.topic_id, u.pos, sum(u.x) AS v FROM n{k} n JOIN u USING (vec_id) "
                         f"WHERE n.topic_id >= {ANCHORED} GROUP BY n.topic_id, u.pos")
        ctes[f"c{k + 1}"] = (f"SELECT c.topic_id, c.pos, coalesce(t.v / t.l, c.x) AS x FROM c{k} c LEFT JOIN ("
                             f"SELECT *, sqrt(sum(v * v) OVER (PARTITION BY topic_id)) AS l FROM t{k}) t "
                             "ON t.topic_id = c.topic_id AND t.pos = c.pos")
    ctes["best"] = (f"SELECT vec_id, topic_id, s FROM ({sim.format(c=f'c{FREE + ROUNDS}')}) q QUALIFY row_number() OVER "
                    "(PARTITION BY vec_id ORDER BY s DESC, topic_id) = 1")
    ctes["sized"] = "SELECT *, count(*) OVER (PARTITION BY topic_id) AS n FROM best"
    return with_ctes(f"SELECT vec_id, CAST(CASE WHEN s < 0.1 OR (topic_id >= {ANCHORED} AND n < {FREE_MIN}) THEN -1 "
                     f"ELSE topic_id END AS BIGINT) AS topic, {r('s')} AS similarity FROM sized", **ctes)


@register("anchored_topics", _sql_anchored)
def q_anchored_topics(spark, d):
    e = fx.table(spark, d, "embeddings")
    anchors = TP.fit_centroids(e.where(F.col("label") < ANCHORED))
    out = CL.anchored_topics(e, anchors, FREE, ROUNDS, threshold=0.1, min_size=FREE_MIN, key="vec_id")
    return rounded(out.select("vec_id", "topic", "similarity"))


# ------------------------------------------------------------------ seeded topics

MIN_TOPIC_SIZE = 100


def _topic_docs(spark, d):
    tp = fx.text_posts(spark, d).withColumnRenamed("lang", "candidate")
    return reliable_checkpoint(TM.clean_topic_posts(tp, stop=()).select("id", "candidate", "clean_text"))


def _seed_sql_ctes() -> dict:
    max_n = max(len(k.split()) for _, k in fx.FIXTURE_SEEDS)
    grams = ["unnest(tk)"] if max_n == 1 else [
        f"unnest(flatten([list_transform(range(1, len(tk) - {n - 2}), lambda i: "
        f"array_to_string(tk[i:i + {n - 1}], ' ')) for n in range(1, {max_n + 1})]))"]
    clean = S.strip_articles(S.clean_topic_text("text", stop=()))
    return dict(
        tp=fx.SQL_TEXT_POSTS,
        docs=f"SELECT id, candidate, clean AS clean_text FROM (SELECT id, lang AS candidate, {clean} "
             f"AS clean FROM tp) x WHERE clean IS NOT NULL",
        seeds="SELECT * FROM " + fx.sql_values(fx.FIXTURE_SEEDS, ["seed_id", "keyword"]),
        g=f"SELECT id, candidate, {grams[0]} AS keyword FROM "
          f"(SELECT id, candidate, string_split(clean_text, ' ') AS tk FROM docs) y",
        hits="SELECT id, candidate, seed_id, count(*) AS score FROM g JOIN seeds USING (keyword) "
             "GROUP BY id, candidate, seed_id",
        best="SELECT id, candidate, seed_id AS topic FROM (SELECT *, row_number() OVER (PARTITION BY "
             "id ORDER BY score DESC, seed_id) AS rn FROM (SELECT * FROM hits UNION ALL "
             "SELECT id, candidate, -1, 0 FROM docs) u) z WHERE rn = 1",
        sizes="SELECT topic, count(*) AS n FROM best GROUP BY topic",
        assigned=f"SELECT b.id, b.candidate, CASE WHEN s.n < {MIN_TOPIC_SIZE} THEN -1 ELSE b.topic END "
                 f"AS topic FROM best b JOIN sizes s USING (topic)",
        labels="SELECT * FROM " + fx.sql_values(fx.FIXTURE_TOPIC_LABELS, ["topic_id", "label"]),
        labelled="SELECT a.*, coalesce(l.label, 'Otros') AS label FROM assigned a "
                 "LEFT JOIN labels l ON l.topic_id = a.topic",
        share="SELECT candidate, label, n, n * 100.0 / sum(n) OVER (PARTITION BY candidate) AS share "
              "FROM (SELECT candidate, label, count(*) AS n FROM labelled GROUP BY candidate, label) c",
    )


def _assigned(spark, d):
    docs = _topic_docs(spark, d)
    seeds = TP.clean_seeds(fx.seeds(spark))
    return TP.seed_topics(docs, seeds, min_size=MIN_TOPIC_SIZE, keep=("candidate",))


def _share(spark, d):
    return DR.topics_by_candidate(_topic_docs(spark, d), fx.seeds(spark), fx.topic_labels(spark),
                                  min_size=MIN_TOPIC_SIZE)


@register("seed_topics", with_ctes("SELECT id, candidate, topic FROM assigned", **_seed_sql_ctes()),
          headline=True)
def q_seed_topics(spark, d):
    return _assigned(spark, d).select("id", "candidate", "topic")


TOPIC_WORDS = 15


@register("topic_words", lambda: with_ctes(
    "SELECT topic, rank, word, count, " + r("score") + " AS score FROM (SELECT *, row_number() OVER ("
    f"PARTITION BY topic ORDER BY round(score, 9) DESC, word) AS rank FROM scored) z WHERE rank <= {TOPIC_WORDS}",
    **_seed_sql_ctes(),
    tw="SELECT CAST(topic AS BIGINT) AS topic, unnest(string_split(clean_text, ' ')) AS word FROM assigned JOIN docs USING (id)",
    cnt="SELECT topic, word, count(*) AS count FROM tw GROUP BY topic, word",
    tot="SELECT topic, sum(count) AS n FROM cnt GROUP BY topic",
    ov="SELECT word, sum(count) AS f FROM cnt GROUP BY word",
    scored="SELECT c.topic, c.word, c.count, CAST(c.count AS DOUBLE) / t.n * ln(1 + (SELECT avg(n) FROM tot) / o.f) AS score "
           "FROM cnt c JOIN tot t USING (topic) JOIN ov o USING (word)"))
def q_topic_words(spark, d):
    docs = _topic_docs(spark, d)
    seeds = TP.clean_seeds(fx.seeds(spark))
    assigned = TP.seed_topics(docs, seeds, min_size=MIN_TOPIC_SIZE, keep=("clean_text",))
    return rounded(CL.topic_words(assigned, F.split("clean_text", " "), TOPIC_WORDS))


@register("topic_share", with_ctes(
    f"SELECT candidate, label, n, {r('share')} AS share FROM share", **_seed_sql_ctes()))
def q_topic_share(spark, d):
    return rounded(_share(spark, d).select("candidate", "label", "n", "share"))


CANDIDATES = ("de", "en", "es", "fr")


@register("topic_matrix", with_ctes(
    "SELECT o.label, CAST(o.label_order AS BIGINT) AS label_order, " + ", ".join(
        f"{r(f'coalesce(max(s.share) FILTER (WHERE s.candidate = {S.q(c)}), 0.0)')} AS {c}"
        for c in CANDIDATES)
    + " FROM (SELECT label, min(topic_id) AS label_order FROM labels GROUP BY label) o "
      "LEFT JOIN share s USING (label) WHERE o.label <> 'Otros' GROUP BY o.label, o.label_order",
    **_seed_sql_ctes()))
def q_topic_matrix(spark, d):
    out = TP.topic_matrix(_share(spark, d), fx.topic_labels(spark), CANDIDATES)
    return rounded(out.select("label", "label_order", *CANDIDATES))


@register("topic_profile_norm", with_ctes(
    "SELECT candidate, label, " + r("CASE WHEN mx > 0 THEN share / mx ELSE share END")
    + " AS share_norm FROM (SELECT *, max(share) OVER (PARTITION BY candidate) AS mx FROM share "
      "WHERE label <> 'Otros') x", **_seed_sql_ctes()))
def q_topic_profile_norm(spark, d):
    out = TP.topic_profile_norm(_share(spark, d))
    return rounded(out.select("candidate", "label", "share_norm"))


# ------------------------------------------------------------------ lexicon sentiment

def _sql_softmax() -> str:
    m = "greatest(ng, nu, ps)"
    e = [f"exp({x} - {m})" for x in ("ng", "nu", "ps")]
    s = " + ".join(e)
    p = [f"({x}) / ({s})" for x in e]
    label = (f"CASE WHEN {p[0]} >= {p[1]} AND {p[0]} >= {p[2]} THEN 'Negative' "
             f"WHEN {p[1]} >= {p[2]} THEN 'Neutral' ELSE 'Positive' END")
    top = f"greatest({p[0]}, {p[1]}, {p[2]})"
    blank = "text IS NULL OR trim(text) = ''"
    return (f"CASE WHEN {blank} THEN 'Neutral' ELSE {label} END AS sentiment_label, "
            f"CASE WHEN {blank} THEN 0.0 ELSE {r(top)} END AS score_label, "
            f"CASE WHEN {blank} THEN 0.0 ELSE {r(p[0])} END AS score_negative, "
            f"CASE WHEN {blank} THEN 0.0 ELSE {r(p[1])} END AS score_neutral, "
            f"CASE WHEN {blank} THEN 0.0 ELSE {r(p[2])} END AS score_positive")


ORACLE_LEXICON = with_ctes(
    f"SELECT id, {_sql_softmax()} FROM (SELECT t.id, t.text, coalesce(s.ng, 0.0) AS ng, "
    "coalesce(s.nu, 0.0) AS nu, coalesce(s.ps, 0.0) AS ps FROM tp t LEFT JOIN sums s USING (id)) x",
    tp=fx.SQL_TEXT_POSTS,
    lex="SELECT * FROM " + fx.sql_values(fx.FIXTURE_LEXICON, ["word", "neg", "neu", "pos"]),
    occ=f"SELECT id, unnest(regexp_extract_all(lower(text), {S.q(TOKEN)})) AS word FROM tp",
    sums="SELECT id, round(sum(neg), 9) AS ng, round(sum(neu), 9) AS nu, round(sum(pos), 9) AS ps "
         "FROM occ JOIN lex USING (word) "
         "GROUP BY id")


@register("softmax_label", with_ctes(
    f"SELECT id, {_sql_softmax()} FROM (SELECT id, CASE WHEN CAST(id AS BIGINT) % 17 = 0 THEN ' ' ELSE 'x' END AS text, "
    "score_negative * 4 AS ng, score_neutral * 4 AS nu, score_positive * 4 AS ps FROM posts) x", posts=fx.SQL_POSTS))
def q_softmax_label(spark, d):
    p = fx.posts(spark, d)
    logits = F.array(*[F.col(f"score_{c}") * 4 for c in ("negative", "neutral", "positive")])
    text = F.when(F.col("id").cast("long") % 17 == 0, " ").otherwise("x")
    return rounded(p.select("id", softmax_label(logits, text).alias("s")).select("id", "s.*"))


@register("lexicon_sentiment", ORACLE_LEXICON, headline=True)
def q_lexicon_sentiment(spark, d):
    out = lexicon_sentiment(fx.text_posts(spark, d), fx.lexicon(spark))
    return rounded(out.select("id", "sentiment_label", "score_label", "score_negative",
                              "score_neutral", "score_positive"))



# ------------------------------------------------------------------ P1 preprocessing

SQL_PREPROCESS = with_ctes(
    "SELECT s.id, s.text, s.sentiment_label, s.score_label, s.score_negative, s.score_neutral, "
    "s.score_positive, e.embedding FROM sent s JOIN emb e USING (id)",
    tp=fx.SQL_TEXT_POSTS,
    un="SELECT * FROM tp WHERE NOT (doc_id % 3 = 0)",
    cp="SELECT id, clean AS text FROM (SELECT id, " + S.clean_post_text("text")
       + " AS clean FROM un) x WHERE clean IS NOT NULL",
    lex="SELECT * FROM " + fx.sql_values(fx.FIXTURE_LEXICON, ["word", "neg", "neu", "pos"]),
    occw=f"SELECT id, unnest(regexp_extract_all(lower(text), {S.q(TOKEN)})) AS word FROM cp",
    sums="SELECT id, round(sum(neg), 9) AS ng, round(sum(neu), 9) AS nu, round(sum(pos), 9) AS ps "
         "FROM occw JOIN lex USING (word) GROUP BY id",
    sent=f"SELECT id, text, {_sql_softmax()} FROM (SELECT c.id, c.text, coalesce(s.ng, 0.0) AS ng, "
         "coalesce(s.nu, 0.0) AS nu, coalesce(s.ps, 0.0) AS ps FROM cp c LEFT JOIN sums s USING (id)) x",
    occ=_sql_token_occ(),
    tv="SELECT token, ('0x' || substr(md5(token), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) "
       "AS vec_id FROM (SELECT DISTINCT token FROM occ) t",
    emb="SELECT id, list(" + r("v", 5) + " ORDER BY pos) AS embedding FROM ("
        "SELECT o.id, p.pos, avg(CAST(p.val AS DOUBLE)) AS v FROM occ o JOIN tv USING (token) "
        "JOIN (SELECT vec_id, unnest(embedding) AS val, unnest(range(0, len(embedding))) AS pos "
        "FROM embeddings) p ON p.vec_id = tv.vec_id GROUP BY o.id, p.pos) x GROUP BY id")


def _preprocessed(spark, d, more=(), **options):
    """Posts of one id twice and a stored table are part of the case: rows of
    ``doc_id % 3 = 0`` are flagged already, a third of the others is stored already."""
    from .preprocess import hashed_embedder, lexicon_scorer, preprocess

    raw = fx.text_posts(spark, d).withColumn("processed", F.col("doc_id") % 3 == 0)
    stored = (raw.where((F.col("doc_id") % 3 == 1) & (F.col("line_no") % 3 == 0))
              .select("id", F.lit("stored").alias("text")))
    return preprocess(raw.select("id", "text", "processed", *more), lexicon_scorer(fx.lexicon(spark)),
                      hashed_embedder(fx.table(spark, d, "embeddings"), EMB_DIM), stored=stored,
                      out=scratch_path(spark, "preprocess"), **options)


@register("preprocess_pipeline", SQL_PREPROCESS)
def q_preprocess_pipeline(spark, d):
    out = _preprocessed(spark, d).new_rows.select(
        "id", "text", "sentiment_label", "score_label", "score_negative",
        "score_neutral", "score_positive", "embedding")
    return rounded(out).withColumn("embedding", _round_array("embedding"))


SQL_STORED = "SELECT id FROM tp WHERE doc_id % 3 = 1 AND line_no % 3 = 0"


@register("preprocess_processed", lambda: with_ctes(
    "SELECT id, 'stored' AS text, CAST(NULL AS VARCHAR) AS sentiment_label FROM stored UNION ALL "
    "SELECT id, text, sentiment_label FROM (" + SQL_PREPROCESS + ") n WHERE id NOT IN (SELECT id FROM stored)",
    tp=fx.SQL_TEXT_POSTS, stored=SQL_STORED))
def q_preprocess_processed(spark, d):
    return _preprocessed(spark, d).processed.select("id", "text", "sentiment_label")


@register("preprocess_flags", lambda: with_ctes(
    "SELECT id, (doc_id % 3 = 0) OR clean IS NOT NULL AS processed FROM (SELECT id, doc_id, "
    + S.clean_post_text("text") + " AS clean FROM tp) x", tp=fx.SQL_TEXT_POSTS))
def q_preprocess_flags(spark, d):
    return _preprocessed(spark, d).raw.select("id", "processed")


def _sql_preprocess_quality() -> str:
    def one(stage, src):
        return (f"SELECT '{stage}' AS stage, count(*) AS n_rows, count(DISTINCT date) AS n_days, "
                f"count(*) FILTER (WHERE date IS NULL) AS n_null_days FROM {src}")

    return with_ctes(
        " UNION ALL ".join([one("cleaned", "cp"), one("scored", "cp"), one("embedded", "cp"),
                            one("processed", "pr"), one("raw", "raw")]),
        tp=fx.SQL_TEXT_POSTS, stored=SQL_STORED,
        raw="SELECT id, CAST(createdAt AS DATE) AS date FROM tp",
        cp="SELECT id, date FROM (SELECT id, CAST(createdAt AS DATE) AS date, " + S.clean_post_text("text")
           + " AS clean FROM tp WHERE NOT (doc_id % 3 = 0)) x WHERE clean IS NOT NULL",
        pr="SELECT id, CAST(NULL AS DATE) AS date FROM stored UNION ALL "
           "SELECT id, date FROM cp WHERE id NOT IN (SELECT id FROM stored)")


@register("preprocess_quality", _sql_preprocess_quality)
def q_preprocess_quality(spark, d):
    # every stage is written and measured; the figures are all that is read afterwards
    done = _preprocessed(spark, d, more=("createdAt",), day=F.to_date("createdAt"), keep=())
    return quality_table(spark, done.quality)


@register("score_sentiment_plugin", ORACLE_LEXICON)
def q_score_sentiment_plugin(spark, d):
    from ..operators.plugin import external_sentiment, lexicon_model

    # an external model in Python workers; equal to the native lexicon scorer
    out = external_sentiment(fx.text_posts(spark, d), lexicon_model(fx.FIXTURE_LEXICON))
    return rounded(out.select("id", "sentiment_label", "score_label", "score_negative",
                              "score_neutral", "score_positive"))

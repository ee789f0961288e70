"""Lemmas from a table of any size (X6, X7): a token join that keeps positions.

A text's words stay where they are, in an array. Rows are written once, compressed, in chunks
of neighbours, and only the distinct words of a chunk go to the lemma table; those that have
another lemma come back as the chunk's dictionary. The chunk's rows meet it as one block, whose
arrays are rewritten in place. So no text is taken apart and put together again, and no word is
sent for each text that has it: what crosses the network is the rows once and the
distinct words of each chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import scratch_path
from ..sources.tables import require_columns, write_table

# A chunk of rows holds at most 2 ** CHUNK_BITS rows and 16 times as many words (one row at least).
CHUNK_BITS = 16
BLOCK_WORDS = 1 << 20           # words of the blocks in one task, about
BUCKETS = 1024                  # of a chunk's dictionary: a word is looked for in one of them


def _bucket(token):
    return F.pmod(F.hash(token), F.lit(BUCKETS))


def known_lemmas(lemmas: DataFrame) -> DataFrame:
    """The (token, lemma) rows that change a word, a row per token (the least lemma), written once."""
    require_columns(lemmas, ["token", "lemma"])
    known = (lemmas.where("token IS NOT NULL AND lemma IS NOT NULL").groupBy("token")
             .agg(F.min("lemma").alias("lemma")).where("token <> lemma"))
    path = write_table(known, scratch_path(known.sparkSession, "lemmas"), compression="zstd")
    return known.sparkSession.read.schema(known.schema).parquet(path)


def apply_lemma_table(df: DataFrame, words: str, lemmas: DataFrame) -> DataFrame:
    """``df`` with every element of the array ``words`` replaced by its lemma in ``lemmas``
    (token, lemma); words without one stay, nulls stay null. A token with several lemmas
    takes the least."""
    return apply_known(df, words, known_lemmas(lemmas))


def apply_known(df: DataFrame, words: str, known: DataFrame) -> DataFrame:
    """``apply_lemma_table`` with what ``known_lemmas`` made. ``df`` is written once, since it is
    read twice: drop columns that nobody needs before."""
    spark = df.sparkSession
    n = F.greatest(F.size(words), F.lit(1))
    # rows of a length class, 0 to CHUNK_BITS, by their place: the longer the fewer
    put = df.withColumns({"_row": F.monotonically_increasing_id(), "_class": F.least(F.greatest(
        F.ceil(F.log2(n / F.lit(16.0))), F.lit(0)), F.lit(CHUNK_BITS)).cast("int")})
    place = F.floor(F.col("_row") / F.pow(F.lit(2.0), F.lit(CHUNK_BITS) - F.col("_class")))
    put = put.withColumn("_chunk", place * (CHUNK_BITS + 1) + F.col("_class")).drop("_row", "_class")
    seen = Observation("lemma-words")
    path = write_table(put.observe(seen, F.sum(n).alias("n")), scratch_path(spark, "lemma-rows"), compression="zstd")
    rows, again = (spark.read.schema(put.schema).parquet(path) for _ in range(2))
    # as many tasks as the words ask for: a task holds its blocks in memory
    tasks = max(1, -(-(seen.get["n"] or 0) // BLOCK_WORDS))

    tokens = (again.select("_chunk", F.explode(F.array_distinct(words)).alias("token"))
              .where("token IS NOT NULL").distinct())
    entries = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    found = (tokens.join(known, "token").select("_chunk", "token", "lemma").repartition(tasks, "_chunk")
             .groupBy("_chunk", _bucket("token").alias("_bucket")).agg(entries("token", "lemma").alias("_of"))
             .groupBy("_chunk").agg(entries("_bucket", "_of").alias("_found")))
    blocks = (rows.repartition(tasks, "_chunk").groupBy("_chunk")
              .agg(F.collect_list(F.struct(*[F.col(c) for c in df.columns])).alias("_rows")))
    buckets = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.try_element_at("_found", b))

    def rewritten(of):
        lemma = lambda x: F.coalesce(F.try_element_at(F.get(of, _bucket(x)), x), x)
        return F.transform("_rows", lambda r: r.withField(words, F.transform(r[words], lemma)))

    out = F.when(F.col("_found").isNull(), F.col("_rows")).otherwise(let(buckets, rewritten))
    return blocks.join(found, "_chunk", "left").select(F.inline(out)).select(*df.columns)

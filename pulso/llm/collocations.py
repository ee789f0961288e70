"""Phrase collocations with the stripes pattern.

A *stripe* is the counter of the words that follow a prefix of 0, 1 or 2 words: one row
holds a prefix, the next words and their counts. Stripes of one prefix merge elementwise.
One structure gives everything that a score needs: a stripe's cells are the counts of the
prefix's extensions, the total of the empty prefix is the number of words, the cell of a
word or pair one level down is the total of the prefix that it is, and the largest cells
on either side of a pair say whether a longer phrase subsumes it.

1. Level by level (0, 1, 2 words of prefix) each task counts the extensions of the texts it
   reads and sends one stripe for each prefix; stripes of a prefix meet, sorted, in one task
   and are merged as they stream in. Cells below ``MIN_COUNT`` are not phrases of interest
   and end there.
2. A phrase that occurs ``MIN_COUNT`` times consists of phrases that do. A bitmap of
   ``BITS`` bits holds the hashes of the phrases kept on a level; the next level counts an
   extension only where both its parts hit the bitmap. A chance hit costs a row and changes
   nothing; a bitmap has the same size for any corpus.
3. A prefix with more than 1/``SHARES`` of all words is cut into segments by the next word,
   in proportion to its count (of ``SEGMENT`` occurrences at least), so no merged stripe
   gathers a large share of the corpus; at most ``SHARES`` prefixes of a level are that
   frequent, which bounds what is sent to the tasks for it.
4. Joins on the counts give each candidate its cuts. Products are decimals of 38 digits.

Defined results: a null text is empty, a null language is ``und``; texts are read whole, in
pieces of ``FLUSH`` tokens that overlap nothing (a stripe row is sent for each piece of a
task's input); repeated rows and ids count each time, ids are not read; ties in the ranking
cannot remain, since phrases differ; an empty table, or one without a phrase that is
frequent enough, gives no rows. Columns other than text and lang are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

MIN_COUNT = 10              # occurrences of a candidate
TOP = 2000                  # phrases of a language in the result
SUBSUMED = (50, 100)        # a candidate goes if 100 * f(longer) >= 50 * f(candidate)
BITS = 1 << 26              # bits of the hash bitmap between levels (8 MB)
SHARES = 65_536             # a prefix above 1/SHARES of all words is cut into segments
SEGMENT = 10_000            # occurrences of a segment at least
ROOT_SEGMENTS = 1024        # segments of the empty prefix
FLUSH = 2_000_000           # tokens counted before a task sends its stripes

#: Fixed values of the query's contract: what ends a piece (words are split at blanks and tabs).
ENDS = b".,;:!?\n\x0b\x0c\r"
END = b"\xff"               # stands for them: no byte of UTF-8
_FOLD = bytes.maketrans(ENDS + bytes(range(65, 91)), END * len(ENDS) + bytes(range(97, 123)))
STRIPES = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("segment", pa.int32()),
                     ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
STRIPE = "lang string, prefix string, segment int, words array<string>, counts array<long>"
MIX = 1_000_003             # hash of a pair: hash of the first word * MIX + hash of the second


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in order, with ``END`` at the ends of pieces."""
    return text.translate(_FOLD).replace(END, b" " + END + b" ").split()


# -- stripes of one task -----------------------------------------------------------------

class Counter:
    """Token ids of one language, and the stripes of one level from them."""

    def __init__(self, lang, level, bitmap, wide):
        self.lang, self.level, self.bitmap, self.wide = lang, level, bitmap, wide
        self.ids = defaultdict(lambda: len(self.ids))
        self.ids[END]                                   # id 0 ends a piece
        self.chunks, self.size = [], 0

    def add(self, text):
        words = tokens(text)
        self.chunks.append(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)))
        self.chunks.append(np.zeros(1, np.int64))
        self.size += len(words) + 1

    def _hit(self, at):
        at = at & (8 * len(self.bitmap) - 1)
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def _hashes(self, names, start=0):
        return np.fromiter((zlib.crc32(w, start) for w in names), np.int64, len(names))

    def _segments(self, code, n):
        """Segments of each prefix; ``code``: a prefix's word id, or first id * n + second."""
        out = np.full(len(code), ROOT_SEGMENTS if self.level == 0 else 1)
        for prefix, size in self.wide.get(self.lang, ()):
            ids = [self.ids.get(w, -1) for w in prefix.encode().split(b" ")]
            if min(ids) >= 0:
                key = ids[0] if len(ids) == 1 else ids[0] * n + ids[1]
                at = int(np.searchsorted(code, key))
                if at < len(code) and code[at] == key:
                    out[at] = size
        return out

    def stripes(self):
        t, names, n = np.concatenate(self.chunks), list(self.ids), len(self.ids)
        if self.level == 0:
            count = np.bincount(t, minlength=n)[1:]
            word, prefix = np.arange(1, n), np.zeros(n - 1, np.int64)
        elif self.level == 1:
            kept = self._hit(self._hashes(names, zlib.crc32(f"{self.lang} ".encode())))
            kept[0] = False
            a, b = t[:-1], t[1:]
            code, count = np.unique((a * n + b)[kept[a] & kept[b]], return_counts=True)
            prefix, word = code // n, code % n
        else:
            first = self._hashes(names, zlib.crc32(f"{self.lang} ".encode())) * MIX
            second = self._hashes(names)
            hit = self._hit(first[t[:-1]] + second[t[1:]]) & (t[:-1] > 0) & (t[1:] > 0)
            at = np.flatnonzero(hit[:-1] & hit[1:])
            pair, index = np.unique(t[at] * n + t[at + 1], return_inverse=True)
            code, count = np.unique(index * n + t[at + 2], return_counts=True)
            prefix, word = pair[code // n], code % n
        if not len(word):
            return []
        new = np.r_[True, prefix[1:] != prefix[:-1]]
        size = self._segments(prefix[new], n)[np.cumsum(new) - 1]
        segment = self._hashes(names)[word] % size
        if (size > 1).any():
            order = np.lexsort((word, segment, prefix))
            prefix, segment, word, count = prefix[order], segment[order], word[order], count[order]
        start = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (segment[1:] != segment[:-1])])
        offsets = pa.array(np.r_[start, len(word)], pa.int32())
        texts = pa.array([b"", *names[1:]], pa.binary()).cast(pa.string())
        if self.level == 2:
            prefixes = pc.binary_join_element_wise(
                texts.take(pa.array(prefix[start] // n)), texts.take(pa.array(prefix[start] % n)), " ")
        else:
            prefixes = texts.take(pa.array(prefix[start]))
        return pa.Table.from_arrays([
            pa.array([self.lang] * len(start), pa.string()), prefixes, pa.array(segment[start], pa.int32()),
            pa.ListArray.from_arrays(offsets, texts.take(pa.array(word))),
            pa.ListArray.from_arrays(offsets, pa.array(count, pa.int64()))],
            schema=STRIPES).to_batches(max_chunksize=5000)


def _count(level, bitmap, wide, flush):
    def task(batches):
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        of, large = {}, wide.value if wide else {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                counter = of.get(lang) or of.setdefault(lang, Counter(lang, level, bits, large))
                counter.add(text)
                if sum(c.size for c in of.values()) >= flush:
                    for c in of.values():
                        yield from c.stripes()
                    of = {}
        for c in of.values():
            yield from c.stripes()
    return task


# -- merging -----------------------------------------------------------------------------

def _merge(least):
    """Stripes in order of (lang, prefix, segment) -> merged cells of ``least`` or more, and a
    row with a null word for the stripe's total."""
    def rows(keys, key, word, count):
        """keys: (lang, prefix) arrays by key number; cells are sorted by key."""
        total = np.bincount(key, count, len(keys[0])).astype(np.int64)
        keep = np.asarray(count) >= least
        at = np.r_[key[keep], np.arange(len(keys[0]))]
        return pa.RecordBatch.from_pydict({
            "lang": keys[0].take(pa.array(at)), "prefix": keys[1].take(pa.array(at)),
            "word": pa.chunked_array([word.filter(pa.array(keep)), pa.nulls(len(total), pa.string())]
                                     ).combine_chunks(),
            "n": np.r_[count[keep], total]})

    def summed(key, words, counts):
        """Equal (key, word) cells added up, by key and then by word."""
        code = words.dictionary_encode()
        index, size = code.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(code.dictionary), 1)
        cells, at = np.unique(key * size + index, return_inverse=True)
        out = np.zeros(len(cells), np.int64)
        np.add.at(out, at, counts)
        return cells // size, code.dictionary.take(pa.array(cells % size)), out

    def task(batches):
        held = None                     # the last stripe, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            t = t.combine_chunks()
            lang, prefix, segment, words, counts = (t.column(i).chunk(0) for i in range(5))
            new = np.r_[True, np.zeros(t.num_rows - 1, bool)]
            for c in (lang, prefix, segment):
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(new)
            of = np.repeat(np.cumsum(new) - 1, pc.list_value_length(words).to_numpy(zero_copy_only=False))
            key, word, count = summed(of, words.flatten(), counts.flatten().to_numpy(zero_copy_only=False))
            last = len(start) - 1
            done = int(np.searchsorted(key, last))
            if last:
                first = pa.array(start[:-1])
                yield rows((lang.take(first), prefix.take(first)), key[:done], word[:done], count[:done])
            one, n = slice(int(start[-1]), int(start[-1]) + 1), len(word) - done
            offsets = pa.array([0, n], pa.int32())
            held = pa.table([lang[one], prefix[one], segment[one],
                             pa.ListArray.from_arrays(offsets, word[done:]),
                             pa.ListArray.from_arrays(offsets, pa.array(count[done:], pa.int64()))],
                            schema=t.schema)
        if held is not None:
            lang, prefix, _, words, counts = (held.column(i).combine_chunks() for i in range(5))
            values = counts.flatten().to_numpy(zero_copy_only=False)
            yield rows((lang, prefix), np.zeros(len(values), np.int64), words.flatten(), values)
    return task


def level(docs: DataFrame, number: int, least: int, bitmap=None, wide=None) -> DataFrame:
    """(lang, prefix, word, n): extensions of prefixes of ``number`` words that occur
    ``least`` times or more; word null: a part of the total of a prefix."""
    key = ["lang", "prefix", "segment"]
    stripes = docs.mapInArrow(_count(number, bitmap, wide, FLUSH), STRIPE)
    cells = (stripes.repartition(*key).sortWithinPartitions(*key)
             .mapInArrow(_merge(least), "lang string, prefix string, word string, n long"))
    return written(cells, f"stripes-{number}")


def _bitmap(spark, cells: DataFrame):
    """The hashes of the phrases kept on a level as a broadcast bitmap of ``BITS`` bits."""
    def crc(*text):
        return F.crc32(F.concat_ws(" ", *text).cast("binary"))

    at = F.when(F.col("prefix") == "", crc("lang", "word")).otherwise(
        crc("lang", "prefix") * MIX + crc("word")).bitwiseAND(F.lit(BITS - 1))
    words = (cells.where("word is not null").select(at.alias("at"))
             .groupBy(F.shiftright("at", 6).alias("i"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")))
    out = np.zeros(BITS // 64, np.int64)
    found = words.toArrow()
    out[found.column("i").to_numpy()] = found.column("bits").to_numpy()
    return spark.sparkContext.broadcast(out.tobytes())


def _wide(spark, phrases: DataFrame, total: int):
    """By language (prefix, segments), for the prefixes above 1/``SHARES`` of all words."""
    size = max(total / SHARES, SEGMENT)
    large = phrases.where(F.col("n") > size).select(
        "lang", "phrase", F.ceil(F.col("n") / F.lit(size)).cast("int").alias("s"))
    out = defaultdict(list)
    for r in large.collect():
        out[r.lang].append((r.phrase, r.s))
    return spark.sparkContext.broadcast(dict(out))


# -- candidates --------------------------------------------------------------------------

def _score(a, left, right):
    wide = "cast({} as decimal(18,0))".format
    return F.expr(f"cast(({wide(a)} * {wide(a)} * 1000000) div ({wide(left)} * {wide(right)}) as bigint)")


def mine(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases."""
    spark = docs.sparkSession
    read = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"),
                       F.coalesce("text", F.lit("")).alias("text"))
    roots = level(read, 0, least)
    sizes = roots.where("word is null").groupBy("lang").agg(F.sum("n").alias("total"))
    total = sizes.agg(F.sum("total")).first()[0] or 0
    ones = roots.where("word is not null").select("lang", F.col("word").alias("phrase"), "n")
    pairs = level(read, 1, least, _bitmap(spark, roots), _wide(spark, ones, total)).where("word is not null")
    joined = F.concat_ws(" ", "prefix", "word")
    twos = pairs.select("lang", joined.alias("phrase"), F.col("prefix").alias("w1"),
                        F.col("word").alias("w2"), F.col("n").alias("a"))
    counts = twos.select("lang", "phrase", F.col("a").alias("n"))
    triples = level(read, 2, least, _bitmap(spark, pairs), _wide(spark, counts, total)).where("word is not null")
    head, tail = F.split("prefix", " ")[0], F.concat_ws(" ", F.split("prefix", " ")[1], "word")
    threes = triples.select("lang", joined.alias("phrase"), F.col("prefix").alias("front"),
                            tail.alias("back"), head.alias("w1"), F.col("word").alias("w3"),
                            F.col("n").alias("a"))

    def with_count(df, of, key, name):
        return df.join(of.select("lang", F.col("phrase").alias(key), F.col("n").alias(name)), ["lang", key])

    # a pair's largest extensions, to the right (its own stripe) and to the left
    longer = (threes.select("lang", F.explode(F.array("front", "back")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    two = with_count(with_count(twos, ones, "w1", "l"), ones, "w2", "r")
    two = (two.join(longer, ["lang", "phrase"], "left")
           .where(f"longer is null or {SUBSUMED[1]} * longer < {SUBSUMED[0]} * a")
           .withColumn("score", _score("a", "l", "r"))
           .select("lang", "phrase", "a", "l", "r", "score"))
    three = with_count(with_count(threes, ones, "w1", "l1"), ones, "w3", "r2")
    three = with_count(with_count(three, counts, "front", "l2"), counts, "back", "r1")
    three = three.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", "phrase", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                         F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"),
                         F.least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = (two.unionByName(three).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= top))
    return best.join(sizes.withColumnRenamed("total", "n"), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir):
    return mine(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), p AS (
  SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), i AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), c1 AS (SELECT lang, ws[i] AS p, count(*) AS f FROM i GROUP BY ALL
), c2 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM i WHERE i + 1 <= len(ws)
          GROUP BY ALL HAVING count(*) >= 10
), c3 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f
          FROM i WHERE i + 2 <= len(ws) GROUP BY ALL HAVING count(*) >= 10
), size AS (SELECT lang, sum(f)::BIGINT AS n FROM c1 GROUP BY lang
), longer AS (
  SELECT lang, w1, w2, max(f) AS m FROM (
    SELECT lang, w1, w2, f FROM c3 UNION ALL SELECT lang, w2, w3, f FROM c3) GROUP BY ALL
), cuts AS (
  SELECT c2.lang, c2.w1 || ' ' || c2.w2 AS phrase, 1 AS k, c2.f AS a, x.f AS l, y.f AS r
  FROM c2 JOIN c1 x ON x.lang = c2.lang AND x.p = c2.w1 JOIN c1 y ON y.lang = c2.lang AND y.p = c2.w2
  LEFT JOIN longer g ON g.lang = c2.lang AND g.w1 = c2.w1 AND g.w2 = c2.w2
  WHERE g.m IS NULL OR 100 * g.m < 50 * c2.f
  UNION ALL
  SELECT c3.lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, 1, c3.f, x.f, y.f
  FROM c3 JOIN c1 x ON x.lang = c3.lang AND x.p = c3.w1
  JOIN c2 y ON y.lang = c3.lang AND y.w1 = c3.w2 AND y.w2 = c3.w3
  UNION ALL
  SELECT c3.lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, 2, c3.f, x.f, y.f
  FROM c3 JOIN c2 x ON x.lang = c3.lang AND x.w1 = c3.w1 AND x.w2 = c3.w2
  JOIN c1 y ON y.lang = c3.lang AND y.p = c3.w3
), s AS (
  SELECT *, (a::HUGEINT * a * 1000000 // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), one AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM one
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM ranked JOIN size USING (lang) WHERE rank <= 2000
"""

"""Benchmark decontamination over a distributed positional inverted index.

The training documents are indexed where they lie: every shard (a few megabytes
of whole texts) stores, for each term that some test item uses, the ascending
list of its positions in the shard, documents being set apart by a gap so that
no phrase reaches over a boundary. The index is written as a table. Term counts
over all shards tell which terms are rare.

A window (``width`` consecutive item words, or the whole of a shorter item) is
answered shard by shard: the postings of its rarest term, moved back by the
term's offset, give the candidate starts; the lists of the other terms, rarest
first, are intersected at their own offsets. With ``slop`` > 0 each term may stand up to
``slop`` words from its place as told from the rarest term (proximity match); 0 asks for
the exact phrase.

The items' windows are made and joined with term counts in Spark. Which terms the index
keeps is told by a bitmap of ``FILTER_BITS`` bits, the same size for any set of items; a
term that hits it by chance is stored and never asked for. Windows are handled in blocks of
``BLOCK_WINDOWS``: only one block's windows, with the counts of its own terms, are collected
and sent to the tasks, and what it finds is written before the next one. Nothing of the
training side is collected; only term counts are shuffled.

Words: A-Z lower-cased, maximal runs of letters a-z, digits and characters
outside ASCII. Null and empty texts have no words. Items without words match
nothing; items with equal windows are all reported. Rows with the same id count
as separate documents, items with the same id are one; what an item without an id says is
found like the rest, but the item has no name to report. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import small_batches, table, written

WIDTH = 10
BLOCK_WINDOWS = 200_000    # windows sent to the tasks at a time
FILTER_BITS = 1 << 24      # bits of the bitmap that tells which terms are indexed (2 MB)
_CANDIDATES = 1 << 20      # candidate starts handled at a time

_INDEX = ("doc_ids array<long>, n_words binary, bases binary, terms binary, ends binary, "
          "places binary")
_MATCH = ("shard long, place int, doc_id long, n_words long, "
          "spans array<struct<first:long,stop:long>>, items array<string>")
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))


def _words_of(texts) -> tuple[np.ndarray, np.ndarray]:
    data, offs = W.flat(texts)
    low = W.lower(data)
    s, e, first = W.bounds(low, offs, W.ALNUM)
    return W.hash_words(low, s, e), first


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows of the test items: ``terms array<long>`` (64-bit word hashes) and the
    ``items`` that have it (sorted; an item without an id has windows but no name)."""
    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                h, first = _words_of(part.column(1))
                names, keys = [], []
                for k, item in enumerate(part.column(0).to_pylist()):
                    own = h[first[k]:first[k + 1]].view(np.int64)
                    size = min(width, len(own))
                    keys += [own[i:i + size] for i in range(len(own) - size + 1 if size else 0)]
                    names += [item] * (len(keys) - len(names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.list_(pa.int64())), pa.array(names, pa.string())], names=["terms", "item"])

    cols = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    small_batches(benchmark.sparkSession)
    return (cols.mapInArrow(run, "terms array<long>, item string").groupBy("terms")
            .agg(F.array_sort(F.collect_set("item")).alias("items")))


def filter_of(found: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A bitmap of fixed size with the low bits of every term of the windows."""
    at = found.select(F.explode("terms").alias("t")).select(F.col("t").bitwiseAND(F.lit(bits - 1)).alias("at"))
    got = at.groupBy(F.shiftright("at", 3).alias("place")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(at & 7 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[got.column("place").to_numpy()] = got.column("bits").to_numpy()
    return out.tobytes()


def build_index(docs: DataFrame, bitmap: bytes, gap: int) -> DataFrame:
    """Positional postings of the terms that hit the bitmap, a row per shard of texts. A term
    that hits it by chance is stored and never asked for."""
    spark = docs.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = np.frombuffer(known.value, np.uint8)
        low = np.uint64(8 * len(bits) - 1)
        for batch in batches:
            for part in W.slices(batch, "text"):
                h, first = _words_of(part.column(1))
                n = np.diff(first)
                base = np.concatenate([[0], np.cumsum(n + gap)[:-1]]).astype(np.int64)
                own = bits[((h & low) >> np.uint64(3)).astype(np.int64)]
                at = np.flatnonzero(own >> (h & np.uint64(7)).astype(np.uint8) & 1)
                found = h[at]
                owner = np.searchsorted(first, at, side="right") - 1
                place = at - first[owner] + base[owner]
                order = np.argsort(found, kind="stable")
                found, place = found[order], place[order]
                last = np.flatnonzero(np.append(found[1:] != found[:-1], len(found) > 0))
                blobs = (n.astype(np.int64), base, found[last], last + 1, place.astype(np.uint32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                     *(pa.array([b.tobytes()], pa.binary()) for b in blobs)],
                    names=["doc_ids", "n_words", "bases", "terms", "ends", "places"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, _INDEX).withColumn("shard", F.monotonically_increasing_id()))


def _postings(row: dict, vocabulary: np.ndarray) -> tuple[np.ndarray, ...]:
    """The shard's postings of the terms in the (sorted) vocabulary, terms as places in it."""
    terms, ends = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["ends"], np.int64)
    places = np.frombuffer(row["places"], np.uint32).astype(np.int64)
    at = np.searchsorted(vocabulary, terms)
    at[at == len(vocabulary)] = 0
    keep = vocabulary[at] == terms if len(vocabulary) else np.zeros(len(terms), bool)
    size = np.diff(ends, prepend=0)
    return (np.frombuffer(row["n_words"], np.int64), np.frombuffer(row["bases"], np.int64),
            at[keep].astype(np.int32), np.cumsum(size[keep]), places[np.repeat(keep, size)])


def term_counts(index: DataFrame) -> DataFrame:
    """``(term, n)``: occurrences of each stored term over the whole corpus."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(row["terms"], np.uint64).view(np.int64)),
                     pa.array(np.diff(np.frombuffer(row["ends"], np.int64), prepend=0))], names=["term", "n"])

    counted = index.select("terms", "ends").mapInArrow(run, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def _block(own: DataFrame, counts: DataFrame, width: int) -> tuple:
    """The windows of one block in the driver: sorted vocabulary, counts of its terms, terms
    ``(n, width)`` as places in the vocabulary (-1: padding), lengths, and each one's items."""
    each = own.select(F.explode("terms").alias("term")).distinct()
    rows = each.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")).toArrow()
    vocabulary = rows.column("term").to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary, n = vocabulary[order], rows.column("n").to_numpy()[order].astype(np.int64)
    got = own.select("terms", "items").toArrow()
    keys, owners = got.column("terms").to_pylist(), got.column("items").to_pylist()
    terms, length = np.full((len(keys), width), -1, np.int32), np.zeros(len(keys), np.int64)
    for k, key in enumerate(keys):
        terms[k, :len(key)] = np.searchsorted(vocabulary, np.array(key, np.int64).view(np.uint64))
        length[k] = len(key)
    return vocabulary, n, terms, length, owners


def match_shard(postings, terms: np.ndarray, length: np.ndarray, rank: np.ndarray,
                slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows found in a shard and where each starts. ``rank``: the offsets of a
    window's terms, rarest first (-1: none)."""
    _, _, present, ends, places = postings
    begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    slot = np.full(int(terms.max(initial=-1)) + 2, -1, np.int64)   # last: padding
    keep = present < len(slot) - 1
    slot[present[keep]] = np.flatnonzero(keep)
    live = np.flatnonzero(((slot[terms] >= 0) | (terms < 0)).all(axis=1) & (length > 0))
    none = np.zeros(0, np.int64)
    if not len(live):
        return none, none
    span = int(places.max()) + 1 + 2 * slop + int(length.max())
    key = np.repeat(np.arange(len(ends)), ends - begin) * span + places
    lead = slot[terms[live, rank[live, 0]]]
    count = ends[lead] - begin[lead]
    cut = np.concatenate([[0], np.cumsum(count)])
    found_w, found_s = [], []
    i = 0
    while i < len(live):
        j = max(i + 1, int(np.searchsorted(cut, cut[i] + _CANDIDATES, side="right")) - 1)
        w = np.repeat(live[i:j], count[i:j])
        where = np.arange(len(w)) - np.repeat(cut[i:j] - cut[i], count[i:j]) + np.repeat(begin[lead[i:j]], count[i:j])
        start = places[where] - rank[w, 0]
        for step in range(1, rank.shape[1]):
            off = rank[w, step]
            todo = off >= 0
            if not todo.any():
                break
            t = slot[terms[w, off]]
            want = t * span + start + off - slop
            k = np.searchsorted(key, want)
            hit = np.zeros(len(w), bool)
            inside = k < len(key)
            hit[inside] = key[k[inside]] <= want[inside] + 2 * slop
            hit &= start + off + slop >= 0
            ok = hit | ~todo
            w, start = w[ok], start[ok]
        found_w.append(w)
        found_s.append(start)
        i = j
    return np.concatenate(found_w), np.concatenate(found_s)


def matches(index: DataFrame, vocabulary: np.ndarray, counts: np.ndarray, terms: np.ndarray,
            length: np.ndarray, owners: list[list[str]], slop: int = 0) -> DataFrame:
    """Per document: the runs of words that stand in a match, and the items found."""
    width = terms.shape[1]
    rarity = np.where(terms >= 0, np.append(counts, 0)[terms], np.iinfo(np.int64).max)
    rank = np.argsort(rarity, axis=1, kind="stable")
    rank[np.arange(width)[None, :] >= length[:, None]] = -1
    possible = (rarity > 0).all(axis=1)          # a term that stands nowhere: no match
    terms, length, rank = terms[possible], length[possible], rank[possible]
    owners = [o for o, p in zip(owners, possible) if p]
    shared = index.sparkSession.sparkContext.broadcast((vocabulary, terms, length, rank, owners))

    def run(batches):
        vocabulary, terms, length, rank, owners = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                post = _postings(row, vocabulary)
                n, base = post[0], post[1]
                w, start = match_shard(post, terms, length, rank, slop)
                start, stop = start.clip(0), start + length[w]
                edge = np.zeros((int(base[-1] + n[-1]) if len(n) else 0) + 2 + width + slop, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, stop, -1)
                inside = np.concatenate([[False], np.cumsum(edge) > 0, [False]])
                turn = np.flatnonzero(inside[1:] != inside[:-1])
                first, stop = turn[0::2], turn[1::2]
                spans: list[list] = [[] for _ in n]
                doc = np.searchsorted(base, first, side="right") - 1
                for d, a, b in zip(doc.tolist(), (first - base[doc]).tolist(),
                                   np.minimum(stop - base[doc], n[doc]).tolist()):
                    spans[d].append({"first": a, "stop": b})
                items: list[set] = [set() for _ in n]
                doc = np.searchsorted(base, start, side="right") - 1
                for pair in np.unique(doc * max(1, len(owners)) + w).tolist():
                    items[pair // len(owners)].update(owners[pair % len(owners)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(n), pa.int64()), pa.array(np.arange(len(n), dtype=np.int32)),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(n), pa.array(spans, _SPANS),
                     pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["shard", "place", "doc_id", "n_words", "spans", "items"])

    return index.mapInArrow(run, _MATCH)


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = 0,
         block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """A row per document row: ``doc_id, n_words, spans`` (runs of words in a match,
    from 0, end exclusive), ``items`` (ids of the items found) and ``n_hit`` (words in
    a match)."""
    asked = written(windows(benchmark, width), "windows")
    index = written(build_index(docs, filter_of(asked), width + 2 * slop + 1), "postings")
    counts = written(term_counts(index), "term-counts")
    blocks = max(1, -(-asked.count() // block_windows))
    of = F.pmod(F.xxhash64("terms"), F.lit(blocks))
    out = None
    for k in range(blocks):
        part = matches(index, *_block(asked.where(of == k) if blocks > 1 else asked, counts, width), slop)
        if blocks > 1:
            # what this block found is written before the next one is sent
            part = written(part.where(F.size("spans") > 0) if k else part, "block-matches")
        out = part if out is None else out.unionByName(part)
    if blocks > 1:
        out = out.groupBy("shard", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    hit = F.aggregate("spans", state, lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["first"], a["reach"]))).alias("n"),
        F.greatest(a["reach"], x["stop"]).alias("reach")), lambda a: a["n"])
    return out.select("doc_id", "n_words", "spans", F.array_sort("items").alias("items"),
                      hit.alias("n_hit"))


def without_matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` whose text has no match, with all their columns. Whether a text
    matches depends on the text alone, so rows are told by its hash: ids may repeat or lack."""
    name = F.xxhash64(F.col("text").cast("string"))
    hit = find(docs.select(name.alias("doc_id"), "text"), benchmark, width).where("n_hit > 0")
    hit = written(hit.select(F.col("doc_id").alias("text hash")).distinct(), "matched-texts")
    return docs.join(hit, name == F.col("text hash"), "left_anti")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def query(spark, sf_dir):
    return digest(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_WORDS = ("regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')")

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark),
win AS (
  SELECT item, least(len(w), {WIDTH}) AS size,
         array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WIDTH}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
g AS (
  SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT rid, i, g.size, item FROM g JOIN win ON g.phrase = win.phrase AND g.size = win.size),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM m) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, item FROM m WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN s USING (rid)
"""

"""Repeated-passage removal with run-length Burrows-Wheeler indexes.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a
smaller ``doc_id`` is removed. Strings are judged on the input and never cross documents.

0. *Copies.* A text that a smaller id has as well is covered as a whole, and left out of
   the rest: the first copy has all its strings.
1. *Dealing.* The smallest ``GRAM``-byte hash in a window (``LENGTH`` bytes) depends on the
   window's bytes only, so equal windows get equal keys. Runs of windows with one key make
   a segment. Keys that stand in one document only are dropped; a key seen in several
   documents of one batch is known to repeat at once, and sends one row per batch to the
   search for the others, so that a hot passage makes no hot group.
2. *Segments.* The bytes of the remaining runs are cut from the texts. Equal segments are
   combined (map-side first) into one with its smallest document.
3. *Index.* Segments with one key meet in a bin. Bins are indexed by a run-length
   Burrows-Wheeler transform with suffix samples at the run ends, sorted to ``DEPTH`` bytes
   (backward search is exact up to that depth). All segments stream through it from their
   last windows in lockstep: one backward step per byte, the match kept at ``LENGTH`` bytes
   by widening the interval to its class. Each class holds the smallest document, so every
   window learns where it first occurs. A bin over ``BIN_BYTES`` would not fit a task: its
   windows are grouped by their bytes instead, in Spark, which is exact as well.
4. *Marks.* An occurrence in a document after its segment's first one is covered as a
   whole; in the first one, its windows that occur in an earlier segment are. The marks
   go back to the texts, and what is left is hashed.

Steps are written as tables, so a lost executor costs no earlier step; tables and shuffle
files that no later step reads are dropped.

Defined cases: null and empty texts, and texts under ``LENGTH`` bytes, lose nothing. Rows
that share a ``doc_id`` don't count as earlier than each other. A null ``doc_id`` is never
earlier and loses nothing. Byte 0xFF, which valid UTF-8 never has, ends segments in an index. Extra
columns are ignored. Keys are 48 bits, segments are named by key and another 64.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import discard, small_batches, table, written

LENGTH = 50
GRAM = 18
RUN = 64                   # windows in a segment at most
DEPTH = 64
BIN_BYTES = 8 << 20
INDEX_BYTES = 1 << 18      # bins are indexed together up to this size

_END = 0xFF
_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))


# ---------------------------------------------------------------- dealing

def window_runs(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one key: key, text number, first window (byte in its text), windows."""
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    up, down = W._powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(W._BYTE[data] * up[:n], out=sums[1:])
    least = W.mix((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])
    reach, width = 1, length - gram + 1          # smallest hash of ``width`` grams, by doubling
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[:reach - width], least[width - reach:])
    room = np.diff(offs) - length + 1            # windows of each text
    doc = np.flatnonzero(room > 0)
    first = offs[doc]
    valid = np.zeros(len(least) + 1, np.int32)
    valid[first] += 1
    np.add.at(valid, first + room[doc], -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[first] = True
    new &= valid
    at = np.flatnonzero(new)
    own = doc[np.searchsorted(first, at, side="right") - 1]
    stop = np.minimum(np.append(at[1:], n), offs[own] + room[own])
    count = stop - at
    pieces = -(-count // RUN)                    # long runs (one key again and again) in pieces
    which = np.repeat(np.arange(len(at)), pieces)
    k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = at[which] + k * RUN
    return least[at[which]] >> np.uint64(16), own[which], start - offs[own[which]], np.minimum(RUN, stop[which] - start)


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``key, doc_id, run, known``: runs of windows; ``known`` > 0, spread at random, if the
    batch itself has the key in several documents. Rows with run -1 only speak for a key."""
    def run(batches):
        for batch in batches:
            keys, owner, runs = [], [], []
            done = 0
            for part in W.slices(batch, "text", 1 << 19):
                data, offs = W.flat(part.column(2))
                key, own, start, count = window_runs(data, offs, length, gram)
                mark = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                keys.append(key)
                owner.append(own + done)
                runs.append(mark[own] << 39 | start << 7 | count)
                done += part.num_rows
            key, own, packed = map(np.concatenate, (keys, owner, runs))
            order = np.lexsort((own, key))
            key, own, packed = key[order], own[order], packed[order]
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[own]
            new = np.append(True, key[1:] != key[:-1])[:len(key)]
            group = np.cumsum(new) - 1
            low = np.full(int(new.sum()), np.iinfo(np.int64).max)
            high = np.full(int(new.sum()), np.iinfo(np.int64).min)
            np.minimum.at(low, group, ids)
            np.maximum.at(high, group, ids)
            shared = low < high
            spread = (W.mix(packed.view(np.uint64) ^ ids.view(np.uint64)) >> np.uint64(50)).astype(np.int32) + 1
            known = np.where(shared[group], spread, 0) if len(key) else spread
            # two rows speak for a shared key, so that it is found repeated elsewhere too
            key = np.concatenate([key, key[new][shared], key[new][shared]])
            ids = np.concatenate([ids, low[shared], high[shared]])
            silent = np.zeros(2 * int(shared.sum()), np.int64)
            packed, known = np.concatenate([packed, silent - 1]), np.concatenate([known, silent])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ids), pa.array(packed), pa.array(known.astype(np.int32))],
                names=["key", "doc_id", "run", "known"])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "key long, doc_id long, run long, known int")


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs ``key, doc_id, run`` whose key stands in several documents."""
    rows = _anchors(docs, length, gram)
    group = Window.partitionBy("key", "known")
    found = (rows.withColumn("lo", F.min("doc_id").over(group)).withColumn("hi", F.max("doc_id").over(group))
             .where("known > 0 OR lo < hi"))
    return found.where("run <> -1").select("key", "doc_id", "run")


# ---------------------------------------------------------------- index

class RunLengthIndex:
    """Run-length BWT of segments, each ended by 0xFF, with suffix samples at run ends.

    Suffixes are sorted by their first ``DEPTH`` bytes: by 8 bytes, then thrice as far with
    three ranks in one key (two in a larger index). Backward search is exact for strings up to that depth.
    """

    def __init__(self, text: np.ndarray, ends: np.ndarray, docs: np.ndarray, length: int = LENGTH):
        """``text``: all segments with their end bytes; ``ends``: where each segment's end byte
        is; ``docs``: the smallest document of each."""
        n = len(text)
        self.text, self.length = text, length
        padded = np.concatenate([text, np.full(DEPTH + 8, _END, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n + DEPTH]
        key = np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)
        parts = 3 if len(key) < 1 << 21 else 2
        ranks, depth = {}, 8
        while True:
            order = np.argsort(key)
            s = key[order]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(np.append(False, s[1:] != s[:-1]))
            ranks[depth] = rank
            if depth >= DEPTH:
                break
            key = rank << (42 if parts == 3 else 32)
            key[:-depth] |= rank[depth:] << (21 if parts == 3 else 0)
            if parts == 3 and len(key) > 2 * depth:
                key[:-2 * depth] |= rank[2 * depth:]
            depth *= parts
        order = order[order < n]                                   # suffixes by their first DEPTH bytes
        # classes: rows that agree in ``length`` bytes
        same = np.ones(max(0, n - 1), bool)
        at, left = 0, length
        for d in sorted(ranks, reverse=True):
            while left >= d:
                r = ranks[d]
                same &= r[order[1:] + at] == r[order[:-1] + at]
                at, left = at + d, left - d
        for j in range(at, length):
            same &= padded[order[1:] + j] == padded[order[:-1] + j]
        starts = np.append(True, ~same)[:n]
        self.class_of = np.cumsum(starts) - 1
        self.class_start = np.flatnonzero(starts)
        self.row_of = np.empty(n, np.int64)
        self.row_of[order] = np.arange(n)
        segment = np.searchsorted(ends, order, side="left")
        self.first_doc = (np.minimum.reduceat(docs[segment], self.class_start) if n else docs[:0])
        # the transform, run by run
        last = np.where(order == 0, _END, padded[order - 1])
        head = np.flatnonzero(np.append(True, last[1:] != last[:-1])[:n])
        self.run_start, self.run_char = head, last[head].astype(np.int64)
        size = np.diff(np.append(head, n))
        self.samples = order[head], order[head + size - 1]          # suffixes at the run ends
        by_char = np.argsort(self.run_char, kind="stable")
        self.run_key = self.run_char[by_char] * (len(head) + 1) + by_char
        self.before = np.append(np.cumsum(size[by_char]) - size[by_char], n)
        count = np.bincount(text, minlength=256)
        self.smaller = np.cumsum(count) - count                      # suffixes with a smaller first byte
        self.base = np.cumsum(np.bincount(last, minlength=256)) - np.bincount(last, minlength=256)

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def step(self, row: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Start of the interval of ``byte + P``, given that of ``P``."""
        c = byte.astype(np.int64)
        run = np.searchsorted(self.run_start, row, side="right") - 1
        inside = np.where(row < len(self.text), row - self.run_start[run], 0)
        k = np.searchsorted(self.run_key, c * (self.runs + 1) + run)
        here = (k < self.runs) & (self.run_key[np.minimum(k, self.runs - 1)] == c * (self.runs + 1) + run)
        rank = self.before[k] - self.base[c] + np.where(here, inside, 0)
        return self.smaller[c] + rank

    def find(self, pattern: bytes) -> int:
        """First row of the interval of ``pattern`` (``DEPTH`` bytes at most), which must
        occur, by backward search."""
        row = np.zeros(1, np.int64)
        for byte in reversed(pattern):
            row = self.step(row, np.array([byte], np.uint8))
        return int(row[0])

    def stream(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Smallest document of each window. ``start``: where segments begin in the text;
        ``count``: their windows. Each segment enters at the row of its last window, and all
        move one byte to the left at a time."""
        out = np.empty(int(count.sum()), np.int64)
        to = np.cumsum(count) - count
        order = np.argsort(-count, kind="stable")
        start, count, to = start[order], count[order], to[order]
        row = self.class_start[self.class_of[self.row_of[start + count - 1]]]
        for j in range(int(count.max(initial=0))):
            alive = int(np.searchsorted(-count, -j, side="left"))    # segments with more than j windows
            row = row[:alive]
            if j:
                # one byte more, then the interval widened to the class of ``length`` bytes
                row = self.step(row, self.text[start[:alive] + count[:alive] - 1 - j])
                row = self.class_start[self.class_of[row]]
            out[to[:alive] + count[:alive] - 1 - j] = self.first_doc[self.class_of[row]]
        return out


def _earlier(length: int):
    """Per segment of a bin, the runs of windows that an earlier document has."""
    def index(key, name, doc, segs, twice):
        offs = np.cumsum([0] + [len(s) + 1 for s in segs])
        text = np.frombuffer(b"\xff".join(segs) + b"\xff", np.uint8)
        start, count = offs[:-1], np.diff(offs) - length
        doc = np.array(doc, np.int64)
        first = RunLengthIndex(text, offs[1:] - 1, doc, length).stream(start, count)
        early = first < np.repeat(doc, count)
        cut = np.cumsum(count) - count
        edge = np.flatnonzero(early[1:] != early[:-1]) + 1
        bounds = np.unique(np.concatenate([[0], edge, cut, [len(early)]]))
        own = np.searchsorted(cut, bounds[:-1], side="right") - 1
        ranges: list[list] = [[] for _ in segs]
        for a, b, s in zip(bounds[:-1].tolist(), bounds[1:].tolist(), own.tolist()):
            if early[a]:
                at = int(cut[s])
                ranges[s].append({"first": a - at, "stop": b - at + length - 1})
        return pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(name, pa.int64()), pa.array(doc), pa.array(ranges, _RANGES),
             pa.array(twice, pa.bool_())], names=["key", "name", "first_doc", "ranges", "twice"])

    def run(batches):
        held: tuple[list, ...] = ([], [], [], [], [])
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= INDEX_BYTES and row[0] != held[0][-1]:     # never cut a bin
                    yield index(*held)
                    held, size = ([], [], [], [], []), 0
                for x, v in zip(held, row):
                    x.append(v)
                size += len(row[3])
        if size:
            yield index(*held)
    return run


_FOUND = "key long, name long, first_doc long, ranges array<struct<first:long,stop:long>>, twice boolean"


def _earlier_in_large(segments: DataFrame, length: int) -> DataFrame:
    """The same for bins too large for a task: windows grouped by their bytes."""
    windows = F.transform(F.sequence(F.lit(1), F.length("segment") - length + 1),
                          lambda i: F.substring("segment", i, F.lit(length)))
    each = segments.select("key", "name", "first_doc", F.posexplode(windows).alias("at", "window"))
    least = written(each.groupBy("key", "window").agg(F.min("first_doc").alias("least")), "large-bins")
    early = (each.join(least, ["key", "window"]).where("least < first_doc")
             .groupBy("key", "name").agg(F.collect_list(F.struct(
                 F.col("at").cast("long").alias("first"), (F.col("at") + length).cast("long").alias("stop"))).alias("ranges")))
    empty = F.expr("CAST(array() AS array<struct<first:long,stop:long>>)")
    return (segments.select("key", "name", "first_doc").join(written(early, "large-ranges"), ["key", "name"], "left")
            .withColumn("ranges", F.coalesce("ranges", empty)))


# ---------------------------------------------------------------- the whole job

def copies_of(docs: DataFrame) -> DataFrame:
    """Rows whose whole text stands in a document with a smaller id: ``doc_id, mark, size``."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", "mark", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("digest"))
    first = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                    .where("first < last").select("digest", "first"), "first-copies")
    return written(rows.join(first, "digest").where("doc_id > first").select("doc_id", "mark", "size").distinct(), "copies")


def _cut(length: int):
    """Segments ``key, segment, doc_id, mark, at`` from texts and their runs."""
    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                data, offs = W.flat(part.column(2))
                runs = part.column(3).combine_chunks() if isinstance(part.column(3), pa.ChunkedArray) else part.column(3)
                n = runs.value_lengths().to_numpy(zero_copy_only=False)
                flat = runs.flatten()
                key = flat.field("key").to_numpy(zero_copy_only=False)
                packed = flat.field("run").to_numpy(zero_copy_only=False)
                own = np.repeat(np.arange(part.num_rows), n)
                mark = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                ok = packed >> 39 == mark[own]
                key, packed, own = key[ok], packed[ok], own[ok]
                at, size = packed >> 7 & 0xFFFFFFFF, (packed & 127) + length - 1
                edge = np.concatenate([[0], np.cumsum(size)])
                take = np.arange(edge[-1]) + np.repeat(offs[own] + at - edge[:-1], size)
                blob = pa.py_buffer(data[take].tobytes())
                segs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edge.astype(np.int32)), blob])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), segs, part.column(0).take(pa.array(own)), pa.array(mark[own].astype(np.int32)), pa.array(at)],
                    names=["key", "segment", "doc_id", "mark", "at"])
    return run


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Have Spark remove each statement's shuffle files when the statement ends; every step
    here is written, so none is read again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Byte ranges to remove: ``doc_id, mark, ranges`` (unsorted, may overlap). Copies of whole
    texts are covered at once; the others are searched without them, since the first copy,
    with a smaller id, has all their strings."""
    copies = copies_of(docs)
    docs = docs.where(F.col("doc_id").isNotNull()).join(copies, ["doc_id", "mark"], "left_anti")
    docs = docs.select("doc_id", "mark", "text")
    found = written(repeated_runs(docs, length, gram), "runs")
    by_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("key", "run")).alias("runs"))
    cut = (docs.join(by_doc, "doc_id").select("doc_id", "mark", "text", "runs")
           .mapInArrow(_cut(length), "key long, segment binary, doc_id long, mark int, at long"))
    name = F.xxhash64("segment").alias("name")
    seen = written(cut, "segments")
    discard(found)
    once = written(seen.groupBy("key", "segment").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
                   .select("key", name, "first_doc", "last_doc", "segment"), "distinct-segments")
    large = written(once.groupBy("key").agg(F.sum(F.length("segment")).alias("n")).where(F.col("n") > BIN_BYTES).select("key"),
                    "large-keys")
    fits = once.join(large, "key", "left_anti").select("key", "name", "first_doc", "segment", (F.col("first_doc") < F.col("last_doc")).alias("twice"))
    result = fits.repartition("key").sortWithinPartitions("key").mapInArrow(_earlier(length), _FOUND)
    rest = once.join(large, "key", "left_semi")
    result = result.unionByName(_earlier_in_large(rest, length).join(
        rest.select("key", "name", (F.col("first_doc") < F.col("last_doc")).alias("twice")), ["key", "name"]))
    # segments of one document that no earlier segment touches mark nothing
    useful = written(result.where("twice OR size(ranges) > 0").drop("twice"), "earlier")
    discard(once)
    own = seen.select("key", name, F.length("segment").cast("long").alias("size"), "doc_id", "mark", "at")
    whole = F.array(F.struct(F.col("at").alias("first"), (F.col("at") + F.col("size")).alias("stop")))
    parts = F.transform("ranges", lambda r: F.struct((F.col("at") + r["first"]).alias("first"), (F.col("at") + r["stop"]).alias("stop")))
    marks = (own.join(useful, ["key", "name"])
             .select("doc_id", "mark", F.when(F.col("doc_id") > F.col("first_doc"), whole).otherwise(parts).alias("ranges"))
             .where("size(ranges) > 0"))
    marks = marks.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("stop")))
    gone = copies.where(F.col("size") >= length).select("doc_id", "mark", all_of.alias("ranges"))
    marks = written(marks.unionByName(gone), "marks")
    discard(seen)
    return marks


def with_mark(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, text``. Where ids repeat, ``mark`` (24 hash bits of the text) tells
    their rows apart; else it is 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    again = docs.where(doc_id.isNotNull()).groupBy(doc_id.alias("id")).count().where("count > 1")
    mark = F.lit(0) if again.isEmpty() else F.shiftrightunsigned(F.xxhash64(text), 40).cast("int")
    return docs.select(doc_id.alias("doc_id"), mark.alias("mark"), text.alias("text"))


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    with _shuffles_dropped(spark):
        docs = with_mark(docs)
        marks = covered(docs, length, gram)

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                data, offs = W.flat(part.column(1))
                out: tuple[list, ...] = ([], [], [], [])
                for i, ranges in enumerate(part.column(2).to_pylist()):
                    own = data[offs[i]:offs[i + 1]]
                    kept, removed, spans, reach = [], 0, 0, 0
                    for r in sorted(ranges or [], key=lambda r: r["first"]):
                        if r["first"] > reach or not spans:
                            kept.append(own[reach:r["first"]])
                            spans += 1
                            reach = r["first"]
                        if r["stop"] > reach:
                            removed += r["stop"] - reach
                            reach = r["stop"]
                    kept.append(own[reach:])
                    for x, v in zip(out, (len(own), removed, spans, b"".join(k.tobytes() for k in kept))):
                        x.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return (docs.join(marks, ["doc_id", "mark"], "left").select("doc_id", "text", "ranges")
            .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def query(spark, sf_dir):
    return remove(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, doc_id, i, substr(h, CAST(2 * i + 1 AS INT), {2 * LENGTH}) AS s
      FROM (SELECT rid, doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE len(h) // 2 >= {LENGTH})),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
m AS (SELECT rid, i FROM w JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT rid, i, CASE WHEN i <= max(i + {LENGTH}) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM m),
r AS (SELECT rid, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM g) x GROUP BY rid, k),
c AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS las, list(b ORDER BY a) AS lbs FROM r GROUP BY rid),
k AS (SELECT d.*, n_spans, n_removed, CASE WHEN n_spans IS NULL THEN h ELSE
        array_to_string(list_transform(range(0, n_spans + 1), lambda j: substr(h,
          CAST(2 * (CASE WHEN j = 0 THEN 0 ELSE lbs[j] END) + 1 AS INT),
          CAST(2 * ((CASE WHEN j = n_spans THEN len(h) // 2 ELSE las[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE lbs[j] END)) AS INT))), '') END AS kept
      FROM d LEFT JOIN c USING (rid))
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(from_hex(kept)) AS kept_sha256
FROM k
"""

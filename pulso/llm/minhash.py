"""Near-duplicate groups: MinHash bands, odd sketches, exact confirmation.

A document's set holds the distinct hashes of its ``SHINGLE``-word shingles (the whole
sequence as one, if shorter). Documents are linked where the Jaccard similarity of
their sets is at least ``THRESHOLD``; linked documents form classes.

1. Each text is turned into its set size, a digest of the set, a MinHash signature
   and an *odd sketch*: the samples ``(i, minhash_i)`` are folded into a bitmap, each
   toggling one bit. The exclusive-or of two sketches holds the samples in which they
   differ, so its population count tells high similarities precisely.
2. Documents with the same digest are one class member; its smallest id goes on.
3. Signatures are cut into bands of rows (``band_rows``: 5 at ``THRESHOLD``). Documents that agree in a band
   share a bucket; each member is paired with the bucket's smallest id, a pair per
   member and not per two members.
4. Pairs whose sketches differ in more than ``MAX_ODD`` bits are dropped; that bound lies
   far beyond what pairs at the threshold differ by (see below). Pairs whose smaller set
   has fewer than ``SMALL`` hashes are compared by the sets themselves, which go along with
   the signature, and not by sketches. What is left is confirmed on the full sets, made
   again from both texts.
5. Confirmed links give components. Buckets whose members are still in several
   components are searched exhaustively, without a cap: members are cut into blocks,
   and block meets block, where sketches (or small sets) are compared in bulk and only pairs
   in different components that pass step 4 come out: sketch pairs to be confirmed like the
   others, links of small sets reduced to a spanning forest of the components they join.
   So no link between documents that share a band is lost, and a group of copies
   that hangs together costs a pair per member.

With 24 bands of 5 rows a pair at similarity 0.85 shares no band with probability
8e-7; other thresholds get the longest rows that lose no more than ``MISSED`` (0.8: 30
bands of 4, 1.4e-7). Each of the 120 hash functions gives ``PARTS`` samples, its smallest value in each
quarter of the hash range (their least is the band's MinHash), 480 in all. At 0.85 these
differ in 72 (deviation 7.8), which toggle 134 of 2048 bits (deviation 14.2, collisions
included); ``MAX_ODD`` lies 6 deviations above, and ``max_odd`` gives the same for other
thresholds. That holds for large sets: the samples of a
quarter of the hash range change together where it holds few hashes, so the deviation
grows as sets get smaller. Below ``SMALL`` hashes the sets themselves are compared.

Defined cases: null and empty texts have an empty set, size 0, and are linked with
nothing. Rows that share a doc_id are one document for linking (any of their texts links
it), and each row is returned. A null doc_id is linked with nothing and is its own component
(null). Extra columns are ignored. Hashes are 64 bits wide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import BATCH_ROWS, batches_of, table, written
from .components import components

SHINGLE = 5
THRESHOLD = (85, 100)       # links: 100 * common >= 85 * union
FUNCTIONS = 120
MISSED = 1e-6               # a pair at the threshold shares no band with this probability at most
PARTS = 4                   # samples of each hash function: the smallest in each part of the hashes
SKETCH_BITS = 2048
SMALL = 256                 # smaller sets are compared themselves, not by sketches
BLOCK = 256                 # members of a bucket in one block of the exhaustive search

_MULTIPLY = np.random.default_rng(7).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNED = ("doc_id long, n_shingles long, digest string, bands array<long>, sketch binary, hashes binary, "
           "text_hash long")


def max_odd(threshold=THRESHOLD, deviations: float = 6) -> int:
    """Odd bits that large sets at the threshold don't exceed by so many deviations."""
    n, bits, t = FUNCTIONS * PARTS, SKETCH_BITS, threshold[0] / threshold[1]
    toggles = 2 * n * (1 - t)
    even = np.exp(-2 * toggles / bits)
    spread = (2 * even) ** 2 * n * t * (1 - t)                     # of the differing samples
    folded = bits / 4 * (1 - even * even) - toggles * even * even  # of the bits that they meet in
    return int(bits / 2 * (1 - even) + deviations * np.sqrt(spread + folded))


def band_rows(threshold=THRESHOLD) -> int:
    """Rows of a band: as many as lose no more than ``MISSED`` at the threshold."""
    t = threshold[0] / threshold[1]
    return max((r for r in range(1, FUNCTIONS + 1)
                if FUNCTIONS % r == 0 and (1 - t ** r) ** (FUNCTIONS // r) <= MISSED), default=1)


MAX_ODD = max_odd()


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    data, offs = W.flat(texts)
    low = W.lower(data)
    s, e, first = W.bounds(low, offs, W.SPACED)
    h = W.hash_words(low, s, e)
    grams, at = W.grams(h, first, size)
    cut = np.searchsorted(at, first)
    n_words = np.diff(first)
    sets = []
    for k in range(len(n_words)):
        if n_words[k] >= size:
            x = np.sort(grams[cut[k]:cut[k + 1]])
            sets.append(x[np.append(True, x[1:] != x[:-1])])
        elif n_words[k]:
            own = h[first[k]:first[k + 1]]
            power = np.array([pow(W._MUL, j + 11, 1 << 64) for j in range(len(own))], np.uint64)
            sets.append(W.mix((own * power).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own))))
        else:
            sets.append(np.zeros(0, np.uint64))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), starts


def min_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``(sets that aren't empty, functions, PARTS)`` samples; the largest number for a
    part without a hash. Values are ascending in each set, so a part is a run of them."""
    full = np.flatnonzero(np.diff(starts))
    out = np.empty((len(full), len(_MULTIPLY), PARTS), np.uint64)
    edge = np.array([(1 << 64) // PARTS * k for k in range(1, PARTS)], np.uint64)
    i = 0
    while i < len(full):                      # few sets at a time, so that they stay in cache
        j = i + 1
        while j < len(full) and starts[full[j] + 1] - starts[full[i]] <= 16384:
            j += 1
        lo, hi = starts[full[i]], starts[full[j - 1] + 1]
        x = values[lo:hi]
        at = np.array([[a, *(a + np.searchsorted(values[a:b], edge))] for a, b in zip(
            starts[full[i:j]], starts[full[i:j] + 1])], np.int64).ravel() - lo
        size = np.diff(np.append(at, len(x)))
        has = size > 0
        for k, a in enumerate(_MULTIPLY):
            least = np.full(len(at), np.iinfo(np.uint64).max)
            least[has] = np.minimum.reduceat(x * a, at[has])
            out[i:j, k] = least.reshape(-1, PARTS)
        i = j
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, ``SKETCH_BITS`` bits in rows of bytes."""
    n = len(samples)
    samples = samples.reshape(n, -1)
    number = np.arange(samples.shape[1], dtype=np.uint64) * np.uint64(W._MUL)
    place = (W.mix(samples + number) % np.uint64(SKETCH_BITS)).astype(np.int64)
    out = np.empty((n, SKETCH_BITS // 8), np.uint8)
    for i in range(0, n, 256):
        own = place[i:i + 256]
        flat = np.bincount((np.arange(len(own))[:, None] * SKETCH_BITS + own).ravel(), minlength=len(own) * SKETCH_BITS)
        out[i:i + 256] = np.packbits((flat & 1).astype(np.uint8).reshape(len(own), SKETCH_BITS), axis=1)
    return out


def odd_bits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of sketches, given as 64-bit words along the last axis."""
    return np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)


def estimate(odd: float, samples: int = FUNCTIONS * PARTS, bits: int = SKETCH_BITS) -> float:
    """Similarity that ``odd`` differing bits stand for."""
    return float(1 + bits / (4 * samples) * np.log(max(1e-9, 1 - 2 * odd / bits)))


def signatures(docs: DataFrame, threshold=THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, sketch, hashes``; the last three null for empty
    sets. ``hashes`` is the whole set where it can be linked with one below ``SMALL``; below
    that there is no sketch."""
    part_of, whole = threshold
    n_rows = band_rows(threshold)
    n_bands = FUNCTIONS // n_rows

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text", 1 << 20):
                values, starts = shingles(part.column(1), size)
                n = np.diff(starts)
                samples = min_hashes(values, starts)
                power = np.array([pow(W._MUL, j + 1, 1 << 64) for j in range(n_rows)], np.uint64)
                bands = (samples.min(axis=2).reshape(-1, n_bands, n_rows) * power).sum(axis=2, dtype=np.uint64)
                bands = W.mix(bands + np.arange(n_bands, dtype=np.uint64) * np.uint64(W._MUL)).view(np.int64)
                sketches = odd_sketch(samples)
                one = np.concatenate([[0], np.cumsum(W.mix(values ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)])
                two = np.concatenate([[0], np.cumsum(W.mix(values + np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
                digest = [f"{int(a):016x}{int(b):016x}" for a, b in zip(
                    one[starts[1:]] - one[starts[:-1]], two[starts[1:]] - two[starts[:-1]])]
                has = n > 0
                row = np.cumsum(has) - 1
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n), pa.array(digest),
                    pa.array([bands[r] if h else None for h, r in zip(has, row)], pa.list_(pa.int64())),
                    pa.array([sketches[r].tobytes() if k >= SMALL else None for k, r in zip(n, row)], pa.binary()),
                    pa.array([values[a:b].tobytes() if 0 < b - a and part_of * (b - a) < whole * SMALL else None
                              for a, b in zip(starts, starts[1:])], pa.binary()),
                    part.column(2)],
                    names=["doc_id", "n_shingles", "digest", "bands", "sketch", "hashes", "text_hash"])

    return _texts(docs).mapInArrow(run, _SIGNED)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       F.xxhash64(F.col("text").cast("string")).alias("text_hash"))


def _sketches(column: list) -> np.ndarray:
    """Sketches as rows of 64-bit words, zeros for missing ones."""
    none = bytes(SKETCH_BITS // 8)
    return np.frombuffer(b"".join(x or none for x in column), np.uint64).reshape(len(column), -1)


def _hashes(column: list) -> list[np.ndarray]:
    """Sets that went along; empty for missing ones."""
    return [np.frombuffer(x or b"", np.uint64) for x in column]


def common_hashes(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each left with each right set."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x])) for x in (left, right)]
    both = np.intersect1d(sides[0][0], sides[1][0])
    marks = []
    for (values, row), x in zip(sides, (left, right)):
        mark = np.zeros((len(x), len(both)), np.float32)
        has = np.isin(values, both)
        mark[row[has], np.searchsorted(both, values[has])] = 1
        marks.append(mark)
    return (marks[0] @ marks[1].T).astype(np.int64)


_PAIR = "a long, b long, ka long, kb long, sure boolean"


def _near(threshold):
    """Keep pairs whose sizes and sketches allow the threshold, and of small sets the links
    (``sure``)."""
    part, whole = threshold
    most = max_odd(threshold)

    def run(batches):
        for batch in batches:
            of = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            na, nb = (of[k].to_numpy() for k in ("na", "nb"))
            left, right = (_sketches(of[k].to_pylist()) for k in ("sa", "sb"))
            ok = (np.minimum(na, nb) * whole >= np.maximum(na, nb) * part)
            small = np.minimum(na, nb) < SMALL
            ok &= small | (odd_bits(left, right) <= most)
            at = np.flatnonzero(ok & small)
            for k, x, y in zip(at, *(_hashes(of[c].take(pa.array(at)).to_pylist()) for c in ("ha", "hb"))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[k] = whole * both >= part * (na[k] + nb[k] - both)
            yield pa.RecordBatch.from_arrays(
                [*(of[k] for k in ("a", "b", "ka", "kb")), pa.array(small)],
                names=["a", "b", "ka", "kb", "sure"]).filter(pa.array(ok))
    return run


def confirm(pairs: DataFrame, members: DataFrame, docs: DataFrame, threshold=THRESHOLD,
            size: int = SHINGLE) -> DataFrame:
    """The links ``(a, b)`` among pairs: those that are sure, and those whose full sets, made
    again from the texts of the two members, are similar enough."""
    open_pairs = pairs.where("NOT sure").select("a", "b", "ka", "kb")
    keys = open_pairs.select(F.explode(F.array("ka", "kb")).alias("key")).distinct()
    needed = members.join(keys, "key").select("key", "doc_id", "text_hash")
    text = _texts(docs).join(needed, ["doc_id", "text_hash"]).groupBy("key").agg(F.first("text").alias("text"))
    two = (open_pairs.join(text.select(F.col("key").alias("kb"), F.col("text").alias("text_b")), "kb")
           .join(text.select(F.col("key").alias("ka"), F.col("text").alias("text_a")), "ka")
           .select("a", "b", "ka", "text_a", "text_b"))
    part, whole = threshold

    def sets(texts):
        values, starts = shingles(texts, size)
        return [values[a:b] for a, b in zip(starts, starts[1:])]

    def run(batches):
        for batch in batches:
            own = batch.column(2).to_pylist()
            place = {}
            for k, a in enumerate(own):
                place.setdefault(a, k)
            left = dict(zip(place, sets(batch.column(3).take(pa.array(list(place.values()), pa.int64())))))
            keep = []
            for a, y in zip(own, sets(batch.column(4))):
                both = len(np.intersect1d(left[a], y, assume_unique=True))
                keep.append(both > 0 and whole * both >= part * (len(left[a]) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return two.mapInArrow(run, "a long, b long").unionByName(pairs.where("sure").select("a", "b"))


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links ``a[i], b[i]`` join what the earlier ones leave apart."""
    root: dict = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def _cross_blocks(threshold):
    """Pairs of two blocks of a bucket that are in different components and whose sizes and
    sketches allow the threshold. Small sets are compared themselves: of their links only those
    that join components which no other link of the two blocks joins come out (``sure``). A
    pair that shares several buckets comes out of the first of its bands only (all its buckets
    are mixed, so that one is searched too)."""
    part, whole = threshold
    most = max_odd(threshold)

    def run(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                sides = []
                for side in ("left", "right"):
                    keys, ids, comp, n, bands = (np.array([m[k] for m in r[side]], np.int64)
                                                 for k in ("key", "doc_id", "component", "n_shingles", "bands"))
                    sides.append((keys, ids, comp, n, bands, _sketches([m["sketch"] for m in r[side]]),
                                  _hashes([m["hashes"] for m in r[side]])))
                (ka, ia, ca, na, ba, sa, ha), (kb, ib, cb, nb, bb, sb, hb) = sides
                common = common_hashes(ha, hb)
                band = int(np.flatnonzero(ba[0] == r["bucket"])[0])
                one = np.array_equal(ka, kb)                 # a block with itself: each pair once
                at = []
                for k in range(len(ka)):
                    ok = np.flatnonzero((cb != ca[k]) & (np.minimum(nb, na[k]) * whole >= np.maximum(nb, na[k]) * part)
                                        & ~(bb[:, :band] == ba[k, :band]).any(axis=1) & ((kb > ka[k]) | (not one)))
                    both = common[k, ok]
                    ok = ok[np.where(np.minimum(nb[ok], na[k]) < SMALL, both * whole >= (na[k] + nb[ok] - both) * part,
                                     odd_bits(sb[ok], sa[k]) <= most)]
                    at.append(np.stack([np.full(len(ok), k), ok], axis=1))
                x, y = np.concatenate(at).T
                sure = np.minimum(na[x], nb[y]) < SMALL
                keep = ~sure
                keep[sure] = _forest(ca[x[sure]], cb[y[sure]])
                x, y, sure = x[keep], y[keep], sure[keep]
                found.append((ia[x], ib[y], ka[x], kb[y], sure))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)],
                                                 names=["a", "b", "ka", "kb", "sure"])
    return run


def link(docs: DataFrame, threshold=THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """A row per document row: ``doc_id, n_shingles, component_id``."""
    spark = docs.sparkSession
    with batches_of(spark, BATCH_ROWS):
        signed = written(signatures(docs, threshold, size), "signatures")
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")

    # documents with equal sets: one member each; the texts of an id are members of their own
    by_digest = written(known.groupBy("digest", "n_shingles").agg(
        F.min("doc_id").alias("member"), F.count("*").alias("n")), "set-members")
    same = (known.join(by_digest.where("n > 1").drop("n"), ["digest", "n_shingles"])
            .where("doc_id <> member").select(F.col("member").alias("a"), F.col("doc_id").alias("b")))
    members = known.join(by_digest, ["digest", "n_shingles"]).where("doc_id = member").dropDuplicates(["doc_id", "digest"])
    members = written(members.select(F.xxhash64("doc_id", "digest").alias("key"), "doc_id", "text_hash", "n_shingles",
                                     "bands", "sketch", "hashes"), "members")

    # bands: buckets with several members, and a pair for each with its smallest
    rows = members.select("key", "doc_id", F.explode("bands").alias("bucket"))
    buckets = written(rows.groupBy("bucket").agg(
        F.min(F.struct("doc_id", "key")).alias("least"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        .where("lo < hi").select("bucket", "least"), "buckets")
    in_bucket = written(rows.join(buckets, "bucket"), "bucket-rows")
    pairs = in_bucket.where("key <> least.key").select(F.col("least.key").alias("ka"), F.col("key").alias("kb")).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(members.select(
            F.col("key").alias(f"k{c}"), F.col("doc_id").alias(c), F.col("sketch").alias(f"s{c}"),
            F.col("hashes").alias(f"h{c}"), F.col("n_shingles").alias(f"n{c}")), f"k{c}")
    pairs = pairs.select("a", "b", "ka", "kb", "na", "nb", "sa", "sb", "ha", "hb")
    with batches_of(spark, BATCH_ROWS):
        pairs = written(pairs.mapInArrow(_near(threshold), _PAIR), "pairs")
    with batches_of(spark, 64):
        links = written(confirm(pairs, members, docs, threshold, size).unionByName(same), "links")
    found = written(components(links), "components")

    # buckets in several components: every pair across them, block by block
    own = F.coalesce("component", "doc_id").alias("component")
    placed = in_bucket.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "key", own)
    placed = written(placed, "placed")
    mixed = written(placed.groupBy("bucket").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
        .where("lo < hi").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    open_rows = (placed.join(mixed, "bucket").join(members.drop("text_hash"), "key")
                 .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")))
    blocks = written(open_rows.groupBy("bucket", "block", "blocks").agg(F.collect_list(F.struct(
        "key", "doc_id", "component", "n_shingles", "bands", "sketch", "hashes")).alias("rows")), "blocks")
    left = blocks.select("bucket", F.col("block").alias("i"), F.col("rows").alias("left"),
                         F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = blocks.select("bucket", F.col("block").alias("j"), F.col("rows").alias("right"))
    more = (left.join(right, ["bucket", "j"]).select("bucket", "left", "right")
            .mapInArrow(_cross_blocks(threshold), _PAIR).dropDuplicates(["ka", "kb"]))
    with batches_of(spark, 16):
        more = written(more.join(pairs, ["ka", "kb"], "left_anti").select("a", "b", "ka", "kb", "sure"), "more-pairs")
    if not more.isEmpty():
        with batches_of(spark, 64):
            extra = written(confirm(more, members, docs, threshold, size), "more-links")
        if not extra.isEmpty():
            found = written(components(links.unionByName(extra)), "components")
    return signed.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, threshold=THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates of a smaller id, with all their columns.
    Of rows that share an id one stays (by hash of the text); rows without an id all do."""
    gone = link(docs, threshold, size).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(written(gone, "duplicates"), "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = written(again, "repeated-ids")
    if again.isEmpty():
        return kept
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    one = (kept.join(again, "doc_id", "left_semi").withColumn("row number", F.row_number().over(order))
           .where(F.col("row number") == 1))
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def query(spark, sf_dir):
    return link(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, root AS component_id, d.doc_id = root AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id
"""

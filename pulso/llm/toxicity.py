"""Toxicity by the nearest labelled examples: exact TF-IDF cosine, block-max index.

Terms are words and word beginnings (first 4, 5 and 6 bytes of longer words), so that
inflected and compound forms meet. The vocabulary is chosen on the labelled examples: all
terms that stand in ``MIN_DOCS`` of them and in ``MIN_SHARE`` of those with label 1 (so that a few
near copies don't make their own words terms), and go clearly with label 1 (chi-squared of
``MIN_CHI2``), however many. Examples and documents are vectors ``(1 + ln tf) * idf`` over it, of
length 1; idf comes from a count of every document of the corpus.

The examples stand in an inverted index cut into blocks of ``BLOCK`` examples, each term
with its largest weight per block. A query takes blocks in order of the bound those
weights give and stops when no block left can hold a nearer example, so its
``NEIGHBOURS`` nearest (ties: smaller id) are exact. Their labels vote with weight
``1 / (distance + DAMP)``; the vote is calibrated on the examples themselves, each
without its own vote. The neighbours are returned as evidence.

Examples are a bounded sample: ``EXAMPLES`` labelled documents by hash of the id, of
those that may be learnt from (crc32 of the id, as text, modulo 3 is not 1). The
index is bounded by the sample and broadcast. Every document is counted and scored whole, in
one narrow pass each; the labels are never joined to all texts.

Defined cases: a document without any chosen term (null and empty texts too) has no
neighbours; its score is the smoothed share of label 1 among such examples. Null labels
and null ids are not learnt from; an id labelled twice counts as 1 if any label is. Equal
texts are one example (smallest id). Without labels of both classes no term is chosen
and all score the examples' share of label 1 (0 without any). A null ``doc_id`` is not held
out. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import platt, small_batches, table, written

EXAMPLES = 8000
MIN_DOCS = 4                 # a term must stand in as many examples ...
MIN_SHARE = 0.02             # ... and in this share of those with label 1
MIN_CHI2 = 20.0
NEIGHBOURS = 15
BLOCK = 64
DAMP = 0.05
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)

_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))


def terms(texts: pa.Array):
    """Term keys of a batch in parts, each with the text that they stand in."""
    data, offs = W.flat(texts)
    low = W.lower(data)
    s, e, first = W.bounds(low, offs, W.ALNUM)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    yield W.hash_words(low, s, e), doc
    for n in PREFIXES:
        at = np.flatnonzero(e - s > n)
        key = np.full(len(at), n << 56, np.uint64)
        for j in range(n):
            key |= low[s[at] + j].astype(np.uint64) << np.uint64(8 * j)
        yield W.mix(key), doc[at]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """The labelled sample with its terms: ``doc_id, toxic, keys, counts``, a text once."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").cast("long")).agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                found = [np.zeros(0, np.uint64)] * part.num_rows
                parts = list(terms(part.column(2)))
                for key, doc in parts:
                    cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                    found = [np.concatenate([x, key[a:b]]) for x, a, b in zip(found, cut, cut[1:])]
                pairs = [np.unique(x, return_counts=True) for x in found]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1),
                    pa.array([k.view(np.int64) for k, _ in pairs], pa.list_(pa.int64())),
                    pa.array([c for _, c in pairs], pa.list_(pa.int64())),
                    part.column(3)], names=["doc_id", "toxic", "keys", "counts", "digest"])

    # the sample is at most ``limit`` rows of two numbers: small enough to be sent everywhere
    rows = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"),
                    F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")))
    rows = rows.mapInArrow(run, "doc_id long, toxic int, keys array<long>, counts array<long>, digest string")
    rows = written(rows, "examples")
    one = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    return (rows.drop("toxic").join(one, ["digest", "doc_id"]).dropDuplicates(["digest"]).drop("digest"))


def vocabulary(rows: DataFrame) -> list[int]:
    """Keys of all terms that go clearly with label 1 (of a bounded sample's terms)."""
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n1 or n1 == n:
        return []
    each = (rows.select("toxic", F.explode("keys").alias("key")).groupBy("key")
            .agg(F.count("*").alias("n"), F.sum("toxic").alias("n1")).where((F.col("n") >= MIN_DOCS) & (F.col("n1") >= MIN_SHARE * n1)))
    expected = F.col("n") * n1 / n
    gap = F.col("n1") - expected
    chi2 = gap * gap / expected + gap * gap / (F.col("n") - expected)
    return sorted(r.key for r in each.where((gap > 0) & (chi2 >= MIN_CHI2)).select("key").collect())


class Terms:
    """Sorted keys of the chosen terms, and their look-up in texts."""

    def __init__(self, keys: list[int]):
        self.keys = np.sort(np.array(keys, np.int64).view(np.uint64)) if keys else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``text * number of terms + term`` of the terms in each text, ascending, and counts."""
        k, found = len(self.keys), [np.zeros(0, np.int64)]
        for key, doc in terms(texts) if k else ():
            at = np.flatnonzero(self.maybe[(key & np.uint64(0xFFFF)).astype(np.int64)])
            t = np.minimum(np.searchsorted(self.keys, key[at]), k - 1)
            ok = self.keys[t] == key[at]
            found.append(doc[at[ok]] * k + t[ok])
        return np.unique(np.concatenate(found), return_counts=True)


def document_counts(docs: DataFrame, keys: list[int]) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many of them each chosen term (in key order) stands."""
    n, chosen = docs.count(), Terms(keys)
    small_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros(len(chosen.keys), np.int64)
        for batch in batches:
            for part in W.slices(batch, "text"):
                pair, _ = chosen.pairs(part.column(0))
                total += np.bincount(pair % max(1, len(total)), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["term", "n"])

    out = np.zeros(len(keys), np.int64)
    if keys:
        counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long")
        for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():
            out[r.term] = r.n
    return n, out


class BlockMax:
    """Labelled examples in an inverted index of blocks with their largest weights."""

    def __init__(self, keys: list[int], rows: list[tuple[int, int, list[int], list[int]]],
                 corpus: tuple[int, np.ndarray] | None = None):
        """``rows``: id, label, term keys, counts; any order. ``corpus``: documents, and how many
        have each term (default: counted on the rows)."""
        rows = sorted(rows, key=lambda r: r[0])
        self.terms = Terms(keys)
        self.keys = self.terms.keys
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.toxic = np.array([r[1] for r in rows], np.int32)
        n, k = len(rows), len(self.keys)
        place = {int(x): i for i, x in enumerate(self.keys.view(np.int64))}
        own = [sorted((place[a], c) for a, c in zip(r[2], r[3]) if a in place) for r in rows]
        total, df = corpus or (n, np.bincount([t for o in own for t, _ in o], minlength=k) if k else np.zeros(0))
        self.idf = np.log((total + 1) / (df + 1)) + 1
        self.n_blocks = -(-n // BLOCK)
        self.vectors = [self.vector(o) for o in own]
        self.most = np.zeros((k, self.n_blocks))
        post: list[list] = [[] for _ in range(k)]
        for i, (t, w) in enumerate(self.vectors):
            for a, b in zip(t.tolist(), w.tolist()):
                post[a].append((i, b))
                self.most[a, i // BLOCK] = max(self.most[a, i // BLOCK], b)
        self.where = [np.array([i for i, _ in p], np.int64) for p in post]
        self.weight = [np.array([w for _, w in p]) for p in post]
        edge = np.arange(self.n_blocks + 1) * BLOCK
        self.cut = [np.searchsorted(w, edge) for w in self.where]
        self._calibrate()

    def vector(self, counted: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of ``(term, count)`` pairs."""
        t = np.array([a for a, _ in counted], np.int64)
        w = (1 + np.log(np.array([c for _, c in counted], float))) * self.idf[t]
        return t, w / max(np.sqrt((w * w).sum()), 1e-300)

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """The ``k`` largest cosines above 0 as ``(cosine, example)``, ties to the smaller."""
        bound = w @ self.most[t]
        best: list[tuple[float, int]] = []
        for b in np.lexsort((np.arange(self.n_blocks), -bound)).tolist():
            if bound[b] <= 0:
                break
            if len(best) == k:
                worst, last = best[-1]
                if bound[b] < worst - 1e-12:
                    break                        # no later block can hold a nearer example
                if bound[b] <= worst + 1e-12 and b * BLOCK > last:
                    continue                     # it could only tie, with larger ids
            score = np.zeros(BLOCK)
            for a, x in zip(t.tolist(), w.tolist()):
                lo, hi = self.cut[a][b], self.cut[a][b + 1]
                if hi > lo:
                    score[self.where[a][lo:hi] - b * BLOCK] += x * self.weight[a][lo:hi]
            if b * BLOCK <= without < (b + 1) * BLOCK:
                score[without - b * BLOCK] = 0
            score = np.round(score, 12)
            hit = np.flatnonzero(score > (best[-1][0] if len(best) == k else 0) - 1e-12)
            hit = hit[score[hit] > 0]
            best = sorted(best + [(float(score[i]), b * BLOCK + i) for i in hit.tolist()],
                          key=lambda x: (-x[0], x[1]))[:k]
        return best

    def vote(self, near: list[tuple[float, int]]) -> float:
        w = np.array([1 / (max(0.0, 1 - s) + DAMP) for s, _ in near])
        return float((w * self.toxic[[i for _, i in near]]).sum() / w.sum())

    def _calibrate(self) -> None:
        votes, truth, bare = [], [], []
        for i, (t, w) in enumerate(self.vectors):
            near = self.nearest(t, w, without=i) if len(t) else []
            if near:
                votes.append(self.vote(near))
                truth.append(self.toxic[i])
            elif not len(t):
                bare.append(self.toxic[i])
        n = len(self.toxic)
        share = float(self.toxic.mean()) if n else 0.0
        both = 0 < share < 1
        self.bare = (sum(bare) + share) / (len(bare) + 1) if both else share
        self.curve = platt(np.array(votes), np.array(truth, float)) if votes else (6.0, -3.0)

    def score(self, counted: list[tuple[int, int]]) -> tuple[float, list[tuple[float, int]]]:
        """Calibrated score of a document's ``(term, count)`` pairs, and its neighbours."""
        near = self.nearest(*self.vector(counted)) if counted else []
        if not near:
            return self.bare, []
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * self.vote(near) + b)))), near

    def look_up(self, texts: pa.Array) -> list[list[tuple[int, int]]]:
        """``(term, count)`` of the chosen terms in each text."""
        k = max(1, len(self.keys))
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        for p, c in zip(*(x.tolist() for x in self.terms.pairs(texts))):
            out[p // k].append((p % k, c))
        return out


def train(docs: DataFrame, labels: DataFrame, limit: int = EXAMPLES) -> BlockMax:
    """The index of a bounded labelled sample; only chosen terms reach the driver."""
    rows = written(examples(docs, labels, limit), "labelled-terms")
    keys = vocabulary(rows)
    kept = rows.select("doc_id", "toxic", F.filter(F.arrays_zip("keys", "counts"), lambda x: (
        x["keys"].isin(*keys) if keys else F.lit(False))).alias("kept")).collect()
    return BlockMax(keys, [(r.doc_id, r.toxic, [x["keys"] for x in r.kept], [x["counts"] for x in r.kept]) for r in kept],
                    document_counts(docs, keys))


def score(docs: DataFrame, model: BlockMax, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted, evidence`` for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model, known = shared.value, {}
        for batch in batches:
            for part in W.slices(batch, "text"):
                scores, evidence = [], []
                for counted in model.look_up(part.column(1)):
                    name = tuple(counted)
                    if name not in known:
                        if len(known) > 20000:      # equal vectors are scored once
                            known.clear()
                        known[name] = model.score(counted)
                    p, near = known[name]
                    scores.append(p)
                    evidence.append([{"doc_id": int(model.ids[i]), "similarity": s, "toxic": int(model.toxic[i])}
                                     for s, i in near])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(scores, pa.float64()),
                    pa.array([int(p >= threshold) for p in scores], pa.int32()), pa.array(evidence, _EVIDENCE)],
                    names=["doc_id", "score", "predicted", "evidence"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"))


def without_toxic(docs: DataFrame, model: BlockMax, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in W.slices(batch, "text"):
                found = model.look_up(part.column(part.schema.get_field_index("text")))
                yield part.filter(pa.array([model.score(c)[0] < threshold for c in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")

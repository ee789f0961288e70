"""Secret scan: exact base rules, and a character convolutional network.

Base rules find assignments to a secret's name, access key ids and long hex runs in
whole texts; their findings always stay. Every other candidate (a long token of key
characters) and its surrounding context is scored by a small convolutional network
written in numpy; those at or above the threshold are added as kind ``cnn``.

The network is trained on labelled findings: the candidates of every document, 1
where a base rule finds them, else 0. What the base rules know is no use to the network, so
each found one is shown with its trigger disguised: the name before an assignment swapped for
another, ``AKIA`` for other capitals, the token's letters and digits drawn anew from another
alphabet. What is left to learn from is how keys look and where they stand.

Equal findings are one row with their number as its weight. Three quarters by hash are trained
on, in shards of about ``SHARD`` rows: in a round every shard goes through its own rows in
mini-batches, from the same weights, and the weights of all shards are averaged by Spark. There
are ``EPOCHS`` rounds at every size. The rest is held out: its scores, counted to 1 / ``GRID``,
calibrate the network (Platt), and the threshold is the most precise one (ties: the lowest) that
keeps ``RECALL`` of the held-out secrets. With fewer than ``MIN_CLASS`` findings of a class, or
none of it on one side, nothing is trained and nothing added.

The scan is one narrow pass over the texts with the trained weights (a few kilobytes)
broadcast; nothing is shuffled. Offsets are code points, end exclusive.

A candidate longer than ``BODY`` characters is read in overlapping pieces, all of them; its score
is that of its highest piece.

Defined cases: null and empty texts have no spans. Long texts are scanned whole. Rows
are independent; repeated ids and extra columns do no harm.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import platt, small_batches, table, written

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: Candidates: runs of key characters, this long with a digit, or longer without.
WITH_DIGIT, WITHOUT_DIGIT = 12, 24
LEFT, BODY, RIGHT = 24, 48, 16            # characters of context, token, context
MIN_CLASS, SHARD, GRID = 10, 8192, 256
RECALL = 0.95
EMBED, WIDTH, FILTERS, EPOCHS = 8, 5, 16, 6

#: Names for disguised assignments: none holds a base rule's.
NAMES = (b"auth", b"key", b"credential", b"bearer", b"signature", b"private", b"client", b"access")

_KEY = np.zeros(256, bool)
_KEY[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()),
                             ("score", pa.float64())]))


def _runs(data: np.ndarray, offs: np.ndarray, kind: np.ndarray, least: int):
    s, e, _ = W.bounds(data, offs, kind)
    ok = e - s >= least
    return s[ok], e[ok]


def base_spans(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, end, kind number)`` in bytes of the batch, over all its texts."""
    found = [(int(s), int(e), 2) for s, e in zip(*_runs(data, offs, _HEX, MIN_HEX))]
    raw, low = data.tobytes(), W.lower(data).tobytes()
    for i in range(len(offs) - 1):
        a, b = int(offs[i]), int(offs[i + 1])
        if any(low.find(n, a, b) >= 0 for n in _NAMES):
            found += [(a + m.start(), a + m.end(), 0) for m in ASSIGN.finditer(raw[a:b])
                      if m.end(2) - m.start(2) >= MIN_ASSIGN]
        if raw.find(b"AKIA", a, b) >= 0:
            found += [(a + m.start(), a + m.end(), 1) for m in ACCESS.finditer(raw[a:b])
                      if m.end() - m.start() >= MIN_ACCESS]
    return sorted(found, key=lambda x: (x[0], x[2]))


def candidates(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the tokens that the network judges."""
    s, e = _runs(data, offs, _KEY, WITH_DIGIT)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    ok = (digits[e] > digits[s]) | (e - s >= WITHOUT_DIGIT)
    return s[ok], e[ok]


def windows(data: np.ndarray, offs: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters around and in each candidate, and the candidate of each row: left context,
    ``BODY`` characters of the token, right context; 0 beyond the text or token, 1 non-ASCII. A
    longer token gives a row for each of its pieces, which overlap by a filter's width."""
    step = BODY - WIDTH + 1
    n = np.maximum(1, -(-(e - s - WIDTH + 1) // step))
    own = np.repeat(np.arange(len(s)), n)
    piece = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    s, e = s[own], e[own]
    doc = np.searchsorted(offs, s, side="right") - 1
    lo, hi = offs[doc], offs[doc + 1]

    def take(at, ok):
        c = data[np.where(ok, at, 0)] if len(data) else np.zeros(at.shape, np.uint8)
        return np.where(ok, np.where(c < 128, np.maximum(c, 2), 1), 0).astype(np.int16)

    left = s[:, None] + np.arange(-LEFT, 0)
    body = (s + piece * step)[:, None] + np.arange(BODY)
    right = e[:, None] + np.arange(RIGHT)
    return np.concatenate([take(left, left >= lo[:, None]), take(body, body < e[:, None]),
                           take(right, right < hi[:, None])], axis=1), own


def disguised(data: np.ndarray, base: list[tuple[int, int, int]], seed: int) -> np.ndarray:
    """A copy of the bytes in which no base rule's trigger stands: names of assignments and
    ``AKIA`` are overwritten, and the letters and digits of each finding are drawn anew."""
    g, out = np.random.default_rng(seed), data.copy()
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    digits = np.frombuffer(b"0123456789", np.uint8)
    alphabets = [np.concatenate([letters, digits]), np.concatenate([letters - 32, digits]),
                 np.concatenate([letters, letters - 32, digits])]
    for a, b, kind in base:
        own = out[a:b]
        named = ASSIGN.match(data[a:b].tobytes()) if kind == 0 else None
        start = named.start(2) if named else 0
        if named:                               # another name of the same length
            name = NAMES[int(g.integers(len(NAMES)))]
            own[:named.end(1)] = np.resize(np.frombuffer(name, np.uint8), named.end(1))
        token = own[start:]
        word = _DIGIT[token] | ((token | 32) >= 97) & ((token | 32) <= 122)
        token[word] = g.choice(alphabets[int(g.integers(3))], int(word.sum()))
    return out


class CharCnn:
    """Embedding, one convolution, max pooling over three regions, a logistic unit."""

    def __init__(self, seed: int = 1):
        g = np.random.default_rng(seed)
        self.w = {
            "embed": g.normal(0, 0.5, (128, EMBED)),
            "conv": g.normal(0, np.sqrt(2 / (WIDTH * EMBED)), (WIDTH * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": g.normal(0, 0.1, 3 * FILTERS), "shift": np.zeros(1)}
        self.slope, self.offset, self.threshold = 1.0, 0.0, 2.0

    _REGIONS = ((0, LEFT), (LEFT, LEFT + BODY), (LEFT + BODY, LEFT + BODY + RIGHT - WIDTH + 1))

    def _forward(self, x):
        emb = self.w["embed"][x]
        n, length, _ = emb.shape
        cols = np.concatenate([emb[:, j:length - WIDTH + 1 + j] for j in range(WIDTH)], axis=2)
        act = cols @ self.w["conv"] + self.w["bias"]
        pool, where = [], []
        for a, b in self._REGIONS:
            k = act[:, a:b].argmax(axis=1)
            where.append(k + a)
            pool.append(np.maximum(np.take_along_axis(act[:, a:b], k[:, None], axis=1)[:, 0], 0))
        pool = np.concatenate(pool, axis=1)
        return cols, where, pool, pool @ self.w["out"] + self.w["shift"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i:i + 256])[3] for i in range(0, len(x), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _gradients(self, x, y, weight):
        cols, where, pool, z = self._forward(x)
        dz = (1 / (1 + np.exp(-z.clip(-30, 30))) - y) * weight / len(x)
        g = {"out": pool.T @ dz, "shift": dz.sum(keepdims=True)}
        dpool = dz[:, None] * self.w["out"] * (pool > 0)
        dconv, dbias = np.zeros_like(self.w["conv"]), np.zeros(FILTERS)
        demb = np.zeros_like(self.w["embed"])
        rows = np.arange(len(x))[:, None]
        for r, k in enumerate(where):
            d = dpool[:, r * FILTERS:(r + 1) * FILTERS]                # (n, FILTERS)
            patch = cols[rows, k]                                      # (n, FILTERS, WIDTH * EMBED)
            dconv += np.einsum("nfc,nf->cf", patch, d)
            dbias += d.sum(axis=0)
            back = (d[:, :, None] * self.w["conv"].T).reshape(len(x), FILTERS, WIDTH, EMBED)
            np.add.at(demb, x[rows[:, :, None], k[:, :, None] + np.arange(WIDTH)], back)
        return g | {"conv": dconv, "bias": dbias, "embed": demb}

    def epoch(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> CharCnn:
        """Once through the rows with Adam, in mini-batches."""
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(a) for k, a in self.w.items()}
        order = np.random.default_rng(seed).permutation(len(y))
        for t, i in enumerate(range(0, len(order), 64), 1):
            k = order[i:i + 64]
            for name, d in self._gradients(x[k], y[k], weight[k]).items():
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.999 * v[name] + 0.001 * d * d
                self.w[name] = self.w[name] - 0.01 * (m[name] / (1 - 0.9 ** t)) / (np.sqrt(v[name] / (1 - 0.999 ** t)) + 1e-8)
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def set_flat(self, values: np.ndarray) -> None:
        for k in sorted(self.w):
            size = self.w[k].size
            self.w[k], values = values[:size].reshape(self.w[k].shape).copy(), values[size:]

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Platt scaling by Newton steps, then the recall-constrained threshold; ``n`` findings
        have score ``z`` and label ``y``."""
        self.slope, self.offset = platt(z, y, n)
        p = self.calibrated(z)
        t, at = np.unique(p, return_inverse=True)
        got, secret = (np.cumsum(np.bincount(at, w, len(t))[::-1])[::-1] for w in (n, n * y))     # at or above
        ok = np.flatnonzero(secret >= RECALL * (n * y).sum())
        best = ok[np.argmax(secret[ok] / got[ok])]
        self.threshold = float((t[best] + t[best - 1]) / 2 if best else t[best])    # halfway to the next score left out

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * z + self.offset).clip(-30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))


def _overlaps(s: np.ndarray, e: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which candidates overlap any of the spans."""
    if not spans:
        return np.zeros(len(s), bool)
    a = np.array([x[0] for x in spans])
    reach = np.maximum.accumulate(np.array([x[1] for x in spans]))
    before = np.searchsorted(a, e, side="left") - 1             # spans that begin before the end
    return (before >= 0) & (reach[np.maximum(before, 0)] > s)


def findings(docs: DataFrame) -> DataFrame:
    """Labelled candidates ``doc_id, start, label, chars``."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                data, offs = W.flat(part.column(1))
                s, e = candidates(data, offs)
                base = base_spans(data, offs)
                label = _overlaps(s, e, base)
                # the disguise depends on the texts alone, not on how they are dealt to tasks
                masked = data.copy()
                for d in np.unique(np.searchsorted(offs, [x[0] for x in base], side="right") - 1).tolist():
                    lo, hi = int(offs[d]), int(offs[d + 1])
                    inside = [(a - lo, b - lo, k) for a, b, k in base if lo <= a < hi]
                    masked[lo:hi] = disguised(data[lo:hi], inside, zlib.crc32(data[lo:hi].tobytes()))
                chars, own = windows(masked, offs, s, e)
                doc = np.searchsorted(offs, s, side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(doc[own])), pa.array(s[own] - offs[doc[own]]),
                    pa.array(label[own].astype(np.int32)),
                    pa.array([x.astype(np.uint8).tobytes() for x in chars], pa.binary())],
                    names=["doc_id", "start", "label", "chars"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, start long, label int, chars binary"))


def _matrix(chars: pa.ChunkedArray) -> np.ndarray:
    return np.array([np.frombuffer(c, np.uint8) for c in chars.to_pylist()]).astype(np.int16)


def _round(rows: DataFrame, model: CharCnn, weights: dict[int, float], number: int) -> np.ndarray:
    """The mean of the weights that the shards reach from the model's."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("chars", "ascending")])
        y = table["label"].to_numpy().astype(float)
        weight = table["n"].to_numpy() * np.where(y == 1, weights[1], weights[0])
        own = CharCnn()
        own.w = dict(shared.value.w)
        own.epoch(_matrix(table["chars"]), y, weight / weight.mean(), number)
        return pa.table({"pos": np.arange(len(own.flat()), dtype=np.int32), "value": own.flat() * len(y),
                         "size": np.full(len(own.flat()), len(y), np.int64)})

    sums = (rows.groupBy("shard").applyInArrow(run, "pos int, value double, size long")
            .groupBy("pos").agg((F.sum("value") / F.sum("size")).alias("value")).orderBy("pos").collect())
    return np.array([r.value for r in sums])


def train(docs: DataFrame) -> CharCnn | None:
    """The network trained on all findings, or None without both classes."""
    rows = findings(docs).groupBy("label", "chars").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows.withColumn("place", F.xxhash64("chars", "label")), "findings")
    held = F.pmod("place", F.lit(4)) == 0
    kinds = {(r.label, r.held): r for r in rows.groupBy("label", held.alias("held")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
    per = {c: sum(kinds[c, h].n for h in (False, True) if (c, h) in kinds) for c in (0, 1)}
    if min(per.values()) < MIN_CLASS or any((c, h) not in kinds for c in (0, 1) for h in (False, True)):
        return None
    total = sum(kinds[c, False].k for c in (0, 1))
    weights = {c: 1 / kinds[c, False].n for c in (0, 1)}
    shards = rows.where(~held).withColumn("shard", F.pmod(F.floor(F.col("place") / 4), F.lit(-(-total // SHARD))))
    model = CharCnn()
    for number in range(EPOCHS):
        model.set_flat(_round(shards, model, weights, number))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            z = shared.value.logits(_matrix(batch.column("chars"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("n"), pa.array(
                np.round(z.clip(-30, 30) * GRID).astype(np.int64))], names=["label", "n", "z"])

    bins = (rows.where(held).select("label", "chars", "n").mapInArrow(scored, "label int, n long, z long")
            .groupBy("z", "label").agg(F.sum("n").alias("n")).orderBy("z", "label").collect())
    model.calibrate(*(np.array([v for v in c], float) for c in
                      ([r.z / GRID for r in bins], [r.label for r in bins], [r.n for r in bins])))
    return model


def _found(data: np.ndarray, offs: np.ndarray, model: CharCnn | None) -> list[tuple[int, int, int, float]]:
    """Base spans and the network's in a batch: start and end byte, kind, score."""
    base = base_spans(data, offs)
    found = [(a, b, k, 1.0) for a, b, k in base]
    if model is not None:
        s, e = candidates(data, offs)
        new = ~_overlaps(s, e, base)
        s, e = s[new], e[new]
        chars, own = windows(data, offs, s, e)
        p = np.zeros(len(s))
        np.maximum.at(p, own, model.score(chars))
        found += [(int(a), int(b), 3, float(q)) for a, b, q in zip(s, e, p) if q >= model.threshold]
    return found


def scan(docs: DataFrame, model: CharCnn | None) -> DataFrame:
    """``doc_id, spans``: base spans and, with a model, the network's, by start then kind."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in W.slices(batch, "text"):
                data, offs = W.flat(part.column(1))
                found = _found(data, offs, model)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])     # bytes to code points
                spans: list[list] = [[] for _ in range(part.num_rows)]
                for a, b, k, q in sorted(found, key=lambda x: (x[0], x[2])):
                    d = int(np.searchsorted(offs, a, side="right")) - 1
                    start = int(points[offs[d]])
                    spans[d].append({"kind": KINDS[k], "start": int(points[a]) - start,
                                     "stop": int(points[b]) - start, "score": q})
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, _SPANS)],
                                                 names=["doc_id", "text", "spans"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, text string, spans array<struct<kind:string,start:long,stop:long,score:double>>"))


def digest(scanned: DataFrame) -> DataFrame:
    name = lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])
    base = F.filter("spans", lambda x: x["kind"] != "cnn")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), count("cnn").alias("n_cnn"),
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", name), ",").alias("spans"))


def redact(docs: DataFrame, model: CharCnn | None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text`` (overlapping or touching ones as one) replaced by
    ``mark``, and ``n_chars``, where there is one, counted anew. Other columns stay."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    put = np.frombuffer(mark.encode(), np.uint8)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in W.slices(batch, "text"):
                at = part.schema.get_field_index("text")
                data, offs = W.flat(part.column(at))
                pieces, size = [], np.diff(offs)
                reach, last = 0, -1
                for a, b, _, _ in sorted(_found(data, offs, model)):
                    doc = int(np.searchsorted(offs, a, side="right")) - 1
                    if a > reach or doc != last:
                        pieces += [data[reach:a], put]
                        size[doc] += len(put)
                        reach, last = a, doc
                    if b > reach:
                        size[doc] -= b - reach
                        reach = b
                pieces.append(data[reach:])
                blob = np.concatenate(pieces)
                edge = np.concatenate([[0], np.cumsum(size)])
                null = part.column(at).is_null()
                text = pa.Array.from_buffers(pa.string(), part.num_rows, [
                    None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(blob.tobytes())])
                cols = list(part.columns)
                cols[at] = pc.if_else(null, pa.scalar(None, pa.string()), text)
                k = part.schema.get_field_index("n_chars")
                if k >= 0 and pieces[1:]:
                    changed = pa.array(size != np.diff(offs))
                    cols[k] = pc.if_else(changed, pc.utf8_length(text).cast(cols[k].type), cols[k])
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return digest(scan(docs, train(docs)))

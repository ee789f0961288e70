"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; its
result is written as Parquet below the session's shared folder and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.

1. toxicity: rejected documents go.
2. near-duplicates: documents are linked at a similarity of ``NEAR`` (0.8) or more; of each
   class the document with the smallest id stays.
3. benchmark decontamination: documents with a benchmark passage go.
4. secrets: found spans are replaced in the texts; no document goes.
5. packing: pieces of documents in bins of 2048 words.

``ORACLE_SQL`` is None: the trained stages (1 and 4) have no SQL form. The tests hold the
pipeline against a brute-force version.
"""

from __future__ import annotations

from pulso.llm import minhash, packing, phrases, secrets_cnn, toxicity
from pulso.llm.common import table, written

NEAR = (80, 100)            # near-duplicates: 100 * common >= 80 * union of five-word shingles


def drop_toxic(spark, docs, sf_dir):
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark, docs, sf_dir):
    return minhash.keep_one(docs, threshold=NEAR)


def drop_contaminated(spark, docs, sf_dir):
    return phrases.without_matches(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    return secrets_cnn.redact(docs, secrets_cnn.train(docs))


def pack_sequences(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

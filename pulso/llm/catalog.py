"""Queries over the test tables, one for each operator."""

from __future__ import annotations

from . import (bwt, collocations, licenses, minhash, packing, phrases, quality, secrets_cnn, topk,
               toxicity, urls, warc, whitening)


def queries():
    return {
        "op1_arc_to_warc": warc.query,
        "op2_threshold_topk": topk.query,
        "op3_minhash_odd_sketch": minhash.query,
        "op4_secret_cnn": secrets_cnn.query,
        "op5_license_rules": licenses.query,
        "op6_best_fit_packing": packing.query,
        "op7_toxicity_knn": toxicity.query,
        "op8_run_length_bwt": bwt.query,
        "op9_url_rules": urls.query,
        "op10_benchmark_phrases": phrases.query,
        "op11_quality_cascade": quality.query,
        "op12_collocation_stripes": collocations.query,
        "op13_feast_whitening": whitening.query,
    }


def oracle_sql():
    return {
        "op1_arc_to_warc": warc.ORACLE,
        "op2_threshold_topk": topk.ORACLE,
        "op3_minhash_odd_sketch": minhash.ORACLE,
        "op8_run_length_bwt": bwt.ORACLE,
        "op10_benchmark_phrases": phrases.ORACLE,
        "op11_quality_cascade": quality.ORACLE,
        "op12_collocation_stripes": collocations.ORACLE,
    }

import random
import re

from pyspark.sql import functions as F

from pulso.llm import quality as Q
from tests.llm.helpers import SPACED, documents, prose

BULLET, CUT = re.compile("^[ \t]*[•‣◦*-]"), re.compile("(\\.\\.\\.|…)[ \t\r]*$")


def measured(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(hit))


def rejecting(text):
    """The rules that reject a text."""
    text = text or ""
    n, chars, symbols, dups, repeats = measured(text)
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return {k for k, v in {
        "few_words": n < 20, "repeated_words": 100 * repeats > 30 * n,
        "many_symbols": 40 * symbols > len(text), "odd_word_length": not 2 * n <= chars <= 12 * n,
        "few_letters": 10 * sum(c.isalpha() for c in text) < 6 * chars,
        "equal_lines": dups >= 3 and 100 * dups > 30 * len(lines),
        "word_runs": 100 * sum(a == b for a, b in zip(words, words[1:])) > 30 * n,
        "bullet_lines": 10 * sum(bool(BULLET.search(x)) for x in lines) > 9 * len(lines),
        "cut_lines": 10 * sum(bool(CUT.search(x)) for x in lines) > 3 * len(lines)}.items() if v}


def texts():
    rnd = random.Random(3)
    plain = [prose(rnd, n) for n in (0, 1, 8, 9, 19, 20, 40, 300)]
    block = prose(rnd, 30)
    return plain + [
        None, "", " \t\n\x0b\x0c\r ", block + "\n" + block, (block + "\n") * 5,
        "same words again and over here now then " * 6, "x " * 30, "a b c d " * 9,
        prose(rnd, 60) + " " + "### $$$ %%% && <> ||" * 9, "\n".join(["- item " + prose(rnd, 5)] * 2 + [
            f"• {prose(rnd, 9)}" for _ in range(12)]), "\n".join(prose(rnd, 9) + "..." for _ in range(9)),
        "ä ö ü " * 25, "12 345 6789 " * 20, "wordwithoutanyspaces" * 400,
        "\n".join(["one line"] * 30), "😀 " * 40, prose(rnd, 20000, 9000), prose(rnd, 3000, 3)]


def test_measures_and_verdicts_equal_brute_force(spark):
    all_texts = texts()
    docs = documents(spark, all_texts).withColumn("rejected_by", F.lit("old"))
    got = {r.doc_id: tuple(r)[1:] for r in Q.measures(docs, "doc_id").collect()}
    assert got == {i: measured(t) for i, t in enumerate(all_texts)}
    for r in Q.judge(docs).collect():
        want = rejecting(all_texts[r.doc_id])
        assert r.rejected_by in want if want else r.rejected_by is None, (r.doc_id, want)
    kept = Q.passing(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(all_texts) if not rejecting(t)}


def test_every_rule_equals_brute_force(spark):
    all_texts = texts()
    docs = documents(spark, all_texts)
    rules = Q.default_rules()
    got = docs.select("doc_id", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in rules.items()]).collect()
    for r in got:
        assert {k for k in rules if r[k]} == rejecting(all_texts[r.doc_id]), r.doc_id


def test_order_is_by_rejection_per_cost_of_what_is_left():
    e = [Q.Estimate("dear", 10.0, 60), Q.Estimate("cheap", 1.0, 30), Q.Estimate("copy", 1.5, 30),
         Q.Estimate("never", 0.1, 0)]
    sets = [(0, 30), (0b0111, 30), (0b0001, 30)]        # all that "copy" rejects, "cheap" rejects
    assert Q.in_order(e, sets) == ["cheap", "dear", "never", "copy"]


def test_a_rejected_row_skips_the_later_rules(spark):
    docs = documents(spark, ["a", "b"])
    t = F.col("text")
    rules = {"first": t.isin("a", "b"), "never_run": F.raise_error(F.lit("was run")).cast("boolean")}
    got = docs.select(Q.cascade(rules, ["first", "never_run"]).alias("x"))
    assert [r.x for r in got.collect()] == ["first", "first"]


def test_empty_table_and_python_free_plan(spark):
    docs = documents(spark, ["a"])
    assert Q.judge(docs.where("false")).collect() == []
    plan = Q.measures(Q.judge(docs), "rejected_by")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    estimates, sets = Q.estimate(docs, Q.default_rules())
    assert [e.rejected for e in estimates][0] == 1 and sum(n for _, n in sets) == 1
    assert all(e.cost >= Q.LEAST_COST for e in estimates)


def test_rules_over_known_measures_give_the_same_verdicts(spark):
    out = Q.measures(documents(spark, texts()), "doc_id", "text")
    known = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}
    order = list(Q.default_rules())
    got = out.select(Q.cascade(Q.default_rules(), order).alias("a"),
                     Q.cascade(Q.default_rules(known=known), order).alias("b")).collect()
    assert all(r.a == r.b for r in got)

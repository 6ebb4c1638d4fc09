"""Quality, language and personal data: held-out accuracy, brute force, and the edge cases."""

import random
import re

import pytest

from tidemark.llm import langid, pii, quality

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    from tidemark.llm.queries import op8_language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op8_language_id(spark, SF).join(docs, "doc_id").filter("held_out and lang is not null").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_language_backs_off_to_shorter_grams(spark):
    rows = [("the thing thereof the other", "en"), ("le être lequel être", "fr"), (None, "fr"), ("x", None)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(1, "theother"), (2, "êtrele"), (3, None), (4, "123 !"), (5, "")], "k int, text string")
    got = {r["k"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "fr"
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    none = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert none.predict("abc") == ("und", 0.0)


def test_quality_held_out(spark):
    from tidemark.llm.queries import op3_quality

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = op3_quality(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_quality_edges(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, None, 0), (3, "b", None), (4, "c", 7)], "doc_id long, text string, quality int")
    model = quality.train(rows)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 50_000)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(docs.limit(0), quality.train(rows.limit(0))).count() == 0


def test_descent_separates():
    import numpy as np

    rng = np.random.default_rng(1)
    x = [np.unique(rng.integers(0, 50, 8) + 50 * (i % 2)) for i in range(200)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(200)])
    ratio = np.r_[-np.ones(50), np.ones(50)]
    w, b = quality.descend(x, y, ratio)
    assert all((float(w[a] @ ratio[a]) + b > 0) == (t > 0) for a, t in zip(x, y, strict=True))


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(PATTERNS[0], t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(PATTERNS[1], t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(PATTERNS[2], t):
        g = re.sub("[^0-9]", "", m[0])
        if 14 <= len(g) <= 19 and sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(g[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(PATTERNS[3], t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["a.@-+1 2(9)%b4_\n5é", "1234567890 -.+"])
def test_base_spans_match_brute_force(alphabet):
    rng = random.Random(7)
    for _ in range(20_000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)


def test_revealing_terms_are_found_and_replaced(spark):
    fill = ["stone river cloud", "green window paper", "seven little lamps", "over distant hills"]
    rows = [(i, f"{fill[i]} zorblax wrote jo@ex.org about {fill[-1 - i]}") for i in range(4)]
    rows += [(10 + i, f"{fill[i % 4]} plain text {i} stands here") for i in range(40)] + [(90, "a note on zorblax alone"), (91, None), (92, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "base_")
    found = {r["base_"]: [(s["kind"], s["start"], s["end"]) for s in r["pii_spans"]] for r in pii.detect(docs).collect()}
    assert found[90] == [("term", 10, 17)]
    assert [k for k, _, _ in found[0]] == ["term", "term", "email", "term"] or ("email", 32, 41) in found[0]
    assert found[91] == found[92] == [] and found[15] == []
    clean = {r["base_"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "zorblax" not in clean[90] and "jo@ex.org" not in clean[0] and "[EMAIL]" in clean[0]
    assert clean[91] is None and clean[15] == dict(rows)[15]
    assert pii.detect(docs.limit(0)).count() == 0


def test_copies_add_no_evidence(spark):
    rows = [(i, "same copy zorblax wrote jo@ex.org today") for i in range(30)] + [(99, "zorblax elsewhere")]
    assert pii.revealing_terms(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_copies_take_no_evidence_away(spark):
    fill = ["stone river cloud", "green window paper", "seven little lamps", "over distant hills", "under quiet bridges"]
    rows = [(i, f"{fill[i]} zorblax wrote jo@ex.org about {fill[-1 - i]}") for i in range(5)] + [(10 + i, f"plain text {i} stands here") for i in range(2000)]
    copies = [(10_000 + i, rows[0][1].replace(" ", " \n" if i % 2 else " ")) for i in range(1000)]
    schema = "doc_id long, text string"
    want = {r["term"]: r["disclosure"] for r in pii.revealing_terms(spark.createDataFrame(rows, schema)).collect()}
    got = {r["term"]: r["disclosure"] for r in pii.revealing_terms(spark.createDataFrame(rows + copies, schema)).collect()}
    assert got == want and got["zorblax"] == pytest.approx(1.0)


@pytest.mark.parametrize("sep", [" ", "\n", "\t", "\n" + " " * 50, " 1234567890 " * 5, "\u3000"])
def test_windows_hold_eight_terms_on_each_side(sep):
    words = [f"{w}{'x' * 30}" for w in "abcdefghij"]
    text = sep.join(["\u00df" * 3, *words, "jo@ex.org", *words[::-1], "jo@ex.org", "\u00df" * 3])
    (_, first, _), (_, last, _) = [c for c in pii.contexts(text) if c[0] == "email:jo@ex.org"]
    assert first == sorted(words[2:]) and last == sorted([*words[:8], "ssssss"])

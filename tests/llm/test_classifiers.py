"""Language id, quality and toxicity: building blocks against brute force, whole jobs by held-out accuracy and odd rows."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from intentlane.llm import langid_crf as L, quality_gbt as Q, toxicity as X
from intentlane.llm.common import is_rest
from intentlane.session import ship_package

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("score", T.StringType()), T.StructField("label", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                       T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())])
ODD = [(9000, None, "aa", "x", "y"), (9001, "", None, None, None), (9002, "123 ,.;!! 456", "bb", None, None), (None, "kola mipa", None, None, None),
       (9003, "kola mipa " * 30000, "aa", None, None), (9003, "kola mipa", "aa", None, None)]


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    k, lengths = 3, np.array([4, 1, 5, 2])
    e, a, pi = rng.random((lengths.sum(), k)) + 0.1, rng.random((k, k)) + 0.1, rng.random(k) + 0.1
    starts = np.cumsum(lengths) - lengths
    got = L.forward_backward(e, starts, lengths, a, pi)
    for s, n in zip(starts, lengths):
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            w = pi[path[0]] * np.prod([e[s + t, path[t]] for t in range(n)]) * np.prod([a[path[t], path[t + 1]] for t in range(n - 1)])
            for t in range(n):
                want[t, path[t]] += w
        assert np.allclose(got[s:s + n], want / want.sum(1, keepdims=True))


def languages(n=160):
    rnd = random.Random(1)
    parts = {"aa": ["ko", "la", "mi", "pa"], "bb": ["schr", "und", "ich", "te"], "cc": ["é", "eau", "oux", "è"]}
    word = lambda lang: "".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(2, 4)))
    line = lambda lang: " ".join(word(lang) for _ in range(12))
    return [(i, "\n".join(line(lang) for _ in range(4)), lang, None, None)
            for i, lang in enumerate(rnd.choice(list(parts)) for _ in range(n))], line


def test_language_id(spark):
    ship_package(spark)
    rows, line = languages()
    switched = (8000, line("aa") + " " + line("bb") + "\n" + line("bb") + "\n" + line("bb"), None, None, None)
    df = spark.createDataFrame([*rows, *ODD, switched], DOCS)
    model = L.train_langid(df, ~is_rest(F.col("doc_id"), 4, 2))
    got = df.select("doc_id", L.predict_language(F.col("text"), model).alias("p")).select("doc_id", "p.*").collect()
    by_id = {r["doc_id"]: r for r in got}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 20 and all(by_id[r[0]]["lang_pred"] == r[2] for r in held)
    assert by_id[8000]["lang_pred"] == "bb" and 0.6 < by_id[8000]["score"] < 0.9   # a quarter is the other language
    for d in (9000, 9001, 9002):
        assert (by_id[d]["lang_pred"], by_id[d]["score"]) == ("und", 0.0)
    assert by_id[None]["lang_pred"] == "aa" and len(got) == len(rows) + len(ODD) + 1
    none = L.train_langid(df.limit(0), F.lit(True))
    assert df.limit(3).select(L.predict_language(F.col("text"), none).alias("p")).first()["p"]["lang_pred"] == "und"


def test_trees_fit_and_flat_walk_matches_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = Q.fit(x, y, trees=40)
    score = trees.score(x)
    assert ((score >= 0.5) == (y == 1)).mean() > 0.97
    for n in range(0, 600, 61):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if x[n, trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        assert abs(score[n] - 1 / (1 + np.exp(-total))) < 1e-9


def test_quality_and_toxicity_jobs(spark):
    ship_package(spark)
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        toxic, bad = rnd.random() < 0.3, rnd.random() < 0.4
        text = [rnd.choice(words) for _ in range(rnd.choice([8, 60]))]
        if toxic:
            text[rnd.randrange(len(text))] = rnd.choice(["zorpel", "z0rpel", "Zоrpel"])   # plain, digit, Cyrillic letter
        elif rnd.random() < 0.05:
            text += ["zorpel", "harvest"]                                               # harmless phrase
        rows.append((i, " ".join(w + "###" if bad else w for w in text), None, None, None))
        labels.append((i, int(not bad), int(toxic), None))
    docs = spark.createDataFrame([*rows, *ODD], DOCS)
    marks = spark.createDataFrame([*labels, (None, 1, 1, None), (9003, None, None, None)], LABELS)
    trees = Q.train_quality(docs, marks)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", Q.quality_score(F.col("text"), trees).alias("s")).collect()}
    held = [r for r in labels if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum((got[d] >= 0.5) == (q == 1) for d, q, _, _ in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values())
    lexicon = X.Lexicon({"zorpel": 5.0}, ["zorpel harvest"], (-4.0, 3.0, 1.0))
    machine = lexicon.automaton()
    assert X.measure(machine, "A Z0RPEL!")[0] == 5.0 and X.measure(machine, "zorpel harvest")[0] == 0.0
    assert X.measure(machine, "azorpel zorpela")[0] == 0.0 and X.measure(machine, None) == (0.0, 0.0)
    learned = X.learn_toxicity(docs, marks)
    scores = {r["doc_id"]: r["s"] for r in docs.select("doc_id", X.toxicity_score(F.col("text"), learned).alias("s")).collect()}
    held = [r for r in labels if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum((scores[d] >= 0.3) == (t == 1) for d, _, t, _ in held) >= 0.9 * len(held)
    empty = X.learn_toxicity(docs.limit(0), marks.limit(0))
    assert docs.select(F.max(X.toxicity_score(F.col("text"), empty))).first()[0] < 1e-6


def test_beginnings_are_judged_by_frequency(spark):
    """A beginning that clean texts hold now and then is still learned from the texts in which it is frequent."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("aeiklmnoprst") for _ in range(rnd.randint(3, 8)))
    rows = []
    for i in range(600):
        toxic = i % 6 == 0
        words = [word() for _ in range(120)]
        for _ in range(6 if toxic else int(i % 5 == 0)):
            words[rnd.randrange(120)] = "grülf" + word()
        rows.append((" ".join(words), int(toxic)))
    ship_package(spark)
    sample = spark.createDataFrame(rows, "_text string, label int")
    lexicon = X.learn_lexicon(sample)
    assert any(e.startswith("grul") and e.endswith("*") for e in lexicon.weights), lexicon
    automaton = lexicon.automaton()
    flagged = X.scores(lexicon, np.array([X.measure(automaton, t) for t, _ in rows])) >= X.THRESHOLD
    assert (flagged == np.array([y == 1 for _, y in rows])).mean() >= 0.98
    assert X.hits(automaton, X.fold("grülf gru")) == []      # a beginning alone is no longer word


def test_too_many_languages_are_an_error(spark):
    ship_package(spark)
    rows = [(n, f"some text {n}", f"x-{n}") for n in range(L.MAX_LANGUAGES + 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="values of lang"):
        L.training_words(df, F.lit(True), "doc_id", "text", "lang")
    assert len(L.training_words(df.where("doc_id > 0"), F.lit(True), "doc_id", "text", "lang")[0]) == L.MAX_LANGUAGES


def test_hot_doc_id_changes_no_sample(spark):
    """A doc_id that a third of all rows share gives one training row, and the models do not depend on its copies or on the order of rows."""
    from intentlane.llm.common import labelled_sample
    ship_package(spark)
    rows, _ = languages(300)
    hot = [(7, f"{rows[7][1]} mipa {n}", "aa", None, None) for n in range(150)]
    marks = spark.createDataFrame([(r[0], r[0] % 2, r[0] % 2, None) for r in rows], LABELS)
    one = spark.createDataFrame([*rows, *hot], DOCS)
    two = spark.createDataFrame([*hot, *reversed(rows)], DOCS).repartition(5)
    a, b = (sorted(map(tuple, labelled_sample(df, marks, "quality", 3, 1, 100).collect())) for df in (one, two))
    assert a == b and len(a) == 100 and len({r[0] for r in a}) == 100
    a, b = (L.training_words(df, ~is_rest(F.col("doc_id"), 4, 2), "doc_id", "text", "lang", 40) for df in (one, two))
    assert a == b and all(sum(x == lang for x, _ in a[1]) <= 40 for lang in a[0])
    assert max(len(w) for _, w in a[1]) == 48           # whole texts: four lines of twelve words


def test_slices_hold_all_rows():
    import pyarrow as pa
    from intentlane.llm.common import text_slices
    texts = [None, "", "a" * 10, "b" * 100, "é" * 7, None, "c"] * 9
    for most in (1, 12, 50, 10_000):
        parts = [p.to_pylist() for p in text_slices(pa.array(texts, pa.string()), most)]
        assert [t for p in parts for t in p] == texts
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= most for p in parts)
    assert list(text_slices(pa.array([], pa.string()))) == []


def test_hits_inside_exceptions_in_a_long_text():
    lexicon = X.Lexicon({"bad": 1.0}, ["bad luck", "a bad luck day"], (0.0, 1.0, 1.0))
    machine = lexicon.automaton()
    text = "a bad luck day, bad luck bad! " * 4000
    assert [h[0] for h in X.hits(machine, X.fold(text))] == [30 * k + 25 for k in range(4000)]

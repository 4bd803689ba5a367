"""LM scoring: exact parts against brute force, the filter against exact counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from intentlane.llm.common import is_rest
from intentlane.llm.lm_bloom import build_filter, score_documents, with_levels
from intentlane.session import ship_package

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("score", T.StringType()), T.StructField("w", T.StringType())])


def data():
    rnd = random.Random(4)
    words = [f"W{i}é" for i in range(400)]
    docs = [(i, " \t\n".join(rnd.choice(words[:1 + rnd.randint(0, 399)]) for _ in range(rnd.choice([0, 3, 60]))), "x", "y")
            for i in range(300)]
    phrase = "always the same seven words in order"
    docs += [(500 + i, phrase, None, None) for i in range(40)]
    return docs + [(900, None, None, None), (None, "w1é W2é unseen", None, None), (901, "word " * 30000, None, None),
                   (3, docs[3][1], None, None), (902, "Never seen before", None, None)]


def test_matches_brute_force(spark):
    ship_package(spark)
    rows = data()
    tokens = lambda t: [w.lower() if w.isascii() else w.replace("W", "w") for w in (t or "").split()] + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    counts = Counter(w for d, t, *_ in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = score_documents(spark.createDataFrame(rows, SCHEMA), ~is_rest(F.col("doc_id"), 10, 0)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    for d, t, *_ in rows:
        r = by_id[d][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] <= 0
    assert len(by_id[3]) == 2 and by_id[3][0] == by_id[3][1]
    assert by_id[510][0]["score"] > by_id[510][0]["base_score"] + 3  # a known phrase: pairs help


def test_filter_reads_counts_back(spark):
    ship_package(spark)
    rng = np.random.default_rng(3)
    h = rng.integers(-2**63, 2**63 - 1, 20_000)
    c = rng.zipf(1.5, 20_000).clip(1, 10**6)
    df = spark.createDataFrame(list(zip(h.tolist(), c.tolist())), "h bigint, c bigint")
    made = build_filter(with_levels(df, 2.0))
    level = made.levels(h.view(np.uint64))
    want = np.where(c >= 2, np.floor(np.log(c / 2.0) / np.log(1.5) + 1e-9) + 1, 0)
    assert (level >= want).all()                      # no false negatives
    assert (level > want).mean() < 0.02
    other = rng.integers(-2**63, 2**63 - 1, 50_000).view(np.uint64)
    assert (made.levels(other) > 0).mean() < 0.02


def test_empty_table(spark):
    ship_package(spark)
    assert score_documents(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    got = score_documents(spark.createDataFrame([(1, "a b", None, None)], SCHEMA), F.lit(False)).collect()
    assert (got[0]["n_tokens"], got[0]["n_known"], got[0]["train_tokens"], got[0]["base_score"]) == (3, 0, 0, 0.0)


def test_rare_pairs_count_in_a_large_corpus(spark):
    ship_package(spark)
    filler = spark.range(1500).select((F.col("id") + 10_000).alias("doc_id"), F.expr("repeat('a ', 30000)").alias("text"))  # 45 million tokens
    phrase = "rare words that two documents have in this order"
    turned = " ".join(reversed(phrase.split()))
    rows = spark.createDataFrame([(1, phrase), (2, phrase), (3, phrase), (4, turned)], "doc_id bigint, text string")
    got = score_documents(filler.unionAll(rows), ~F.col("doc_id").isin(3, 4)).where("doc_id < 10").collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[3] > score[4] + 8


def test_weights_come_from_all_training_documents(spark):
    ship_package(spark)
    rnd = random.Random(8)
    rows = [(n, " ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randint(1, 30)))) for n in range(5000)]
    # each of these documents alone has words of its frequency, always in the same order
    rows += [(10_000 + t, " ".join(f"x{t}y{i}" for i in range(10)) + " ") for t in range(3)]
    rows[-3:] = [(d, text * times) for (d, text), times in zip(rows[-3:], (20, 50, 100))]
    got = score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), F.lit(True)).where("doc_id >= 10000")
    for r in got.collect():
        assert r["score"] / r["n_tokens"] > -0.5 > r["base_score"] / r["n_tokens"]


def test_score_equals_a_plain_model(spark):
    """The same levels, codebooks and weights from exact counters; a false probe may change a few documents."""
    from intentlane.llm.lm_bloom import _GRID, Model, code_of, levels_of
    ship_package(spark)
    rows = data()
    tokens = lambda t: [w.lower() if w.isascii() else w.replace("W", "w") for w in (t or "").split()] + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    texts = [(d, tokens(t)) for d, t, *_ in rows]
    pairs_of = lambda ws: list(zip([None, *ws[:-1]], ws))
    words = Counter(w for d, ws in texts if not held(d) for w in ws)
    pairs = Counter(p for d, ws in texts if not held(d) for p in pairs_of(ws))
    level = lambda c: int(levels_of(np.array([c]))[0])

    def codebook(counts):
        by = {}
        for c in counts.values():
            by.setdefault(level(c), []).append(c)
        out = np.zeros(max(by) + 1)
        for k in range(1, len(out)):
            out[k] = np.mean(by[k]) if k in by else out[k - 1] * 1.5
        return out

    code = lambda p: int(code_of(level(words[p[0]]), level(words[p[1]]), level(pairs[p]) if words[p[0]] and words[p[1]] else 0))
    model = Model(sum(words.values()), len(words), codebook(words), codebook(pairs), np.zeros(1))
    seen = Counter(code(p) for d, ws in texts if not held(d) for p in pairs_of(ws))
    codes, n = np.array(list(seen)), np.array(list(seen.values()))
    single, pair, of = model.estimates(codes)
    pair = np.maximum(pair - 1.0 / np.maximum(model.words[of], 1.0), 0.0)
    gain = np.stack([np.bincount(of, n * np.log(w * pair + (1 - w) * single), minlength=len(model.words)) for w in _GRID], 1)
    model.weights = _GRID[gain.argmax(1)]
    model.weights[0] = 0.0
    got = {}
    for r in score_documents(spark.createDataFrame(rows, SCHEMA), ~is_rest(F.col("doc_id"), 10, 0)).collect():
        got[r["doc_id"]] = r["score"]
    want = {d: float(model.log10(np.array([code(p) for p in pairs_of(ws)])).sum()) for d, ws in texts}
    equal = [abs(got[d] - want[d]) < 1e-6 * max(1, abs(want[d])) for d in want]
    assert np.mean(equal) > 0.9 and all(abs(got[d] - want[d]) < 0.05 * abs(want[d]) + 3 for d in want)


def test_large_blocks_are_stored_in_small_row_groups(spark, tmp_dir):
    """A row group, which a task holds whole, had all large rows of a file, and a page a hundred of them."""
    import glob
    import pyarrow.parquet as pq
    from intentlane.llm.lm_bloom import stored
    rows = spark.range(0, 40, 1, 1).select("id", F.expr("array_join(transform(sequence(1, 15000), i -> uuid()), '')").cast("binary").alias("blob"))
    out = stored(rows, "lm-test")     # 20 MB
    (path,) = glob.glob(out.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0] + "/*.parquet")
    meta = pq.read_metadata(path)
    assert meta.num_rows == 40 and max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 8 << 20
    assert out.count() == 40


def test_documents_are_not_dealt_by_word(spark):
    """Each document's words crossed the disk a row each, with the document's keys, and again as sums."""
    ship_package(spark)
    got = score_documents(spark.createDataFrame(data(), SCHEMA), ~is_rest(F.col("doc_id"), 10, 0))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_words_of_one_hash_keep_their_counts(spark, monkeypatch):
    """The base score is exact: words are told apart by themselves, not by their hashes."""
    from intentlane.llm import lm_bloom
    from intentlane.llm.lm_bloom import number_texts, packed_words, unpacked, unpacked_words, word_totals
    ship_package(spark)
    words = [b"a", b"", b"\xc3\xa9"]
    assert unpacked_words(packed_words(words)) == words and unpacked_words(packed_words([b""])) == [b""]
    rows = spark.createDataFrame([(1, True, "x y z x")], "id bigint, train boolean, text string")
    blocks_ = number_texts(rows, {b"z": 7}, 10.0)
    one = F.lit(bytes(4 * 8)).alias("hashes")      # all words of the block have the hash 0
    blocks_ = blocks_.select("block", one, "known", "tail")
    monkeypatch.setattr(lm_bloom, "hashed_words", lambda c: c.select("w", F.lit(0).cast("bigint").alias("h"), "c"))
    counted = spark.createDataFrame([(b"x", 2), (b"y", 1), (b"z", 7)], "w binary, c bigint")
    (r,) = word_totals(blocks_, counted, 10).collect()
    assert unpacked(r["counts"], np.int64).tolist() == [2, 1, 0]      # x, y and the end token


def test_blocks_hold_words_once(spark):
    """A block held eight bytes of hash for each word beside the word, and again in the shuffle of the last join."""
    from intentlane.llm.lm_bloom import number_texts, tail_of, unpacked, unpacked_numbers
    ship_package(spark)
    words = [f"w{i}" for i in range(20_000)]
    rows = spark.createDataFrame([(1, True, " ".join(words))], "id bigint, train boolean, text string")
    (r,) = number_texts(rows, {b"w7": 9, b"w3": 5}, 10.0).collect()
    assert sum(len(x) for x in r if isinstance(x, (bytes, bytearray))) < 8 * len(words)
    kept = [[b"w7", b"w3"][i] for i in unpacked_numbers(r["known"])] + tail_of(r["tail"])
    assert [kept[i] for i in unpacked(r["ids"], np.uint32)] == [w.encode() for w in words] + [b""]
    assert kept[r["end_id"]] == b"" and np.frombuffer(r["n_head"], np.int64).tolist() == [2]


def test_count_and_level_of_a_word_come_together(spark):
    """Two shuffles of each block's rare words, one for the counts and one for the levels, were on disk at once."""
    from intentlane.llm.lm_bloom import hashes_of, levels_of, number_texts, tail_of, unpacked, word_totals
    ship_package(spark)
    counts = {f"w{i}".encode(): 1 + i % 40 for i in range(300)}
    rows = spark.createDataFrame([(1, True, " ".join(f"w{i}" for i in range(0, 320, 2)))], "id bigint, train boolean, text string")
    blocks_ = number_texts(rows, {b"w0": 100}, 10.0)
    tail = tail_of(blocks_.first()["tail"])
    assert len(tail) == 160 and b"w0" not in tail
    counted = spark.createDataFrame([(bytearray(w), c) for w, c in counts.items()], "w binary, c bigint")
    got = word_totals(blocks_, counted, 10, 5, np.ones(20)).orderBy("shard").collect()
    assert [r["shard"] for r in got] == [0, 1, 2, 3, 4]
    want = np.array([counts.get(w, 0) for w in tail])[np.argsort(hashes_of(tail))]
    assert np.concatenate([unpacked(r["counts"], np.int64) for r in got]).tolist() == want.tolist()
    level = np.concatenate([unpacked(r["levels"], np.int8) for r in got])
    assert (level >= levels_of(want)).all() and (level == levels_of(want)).mean() > 0.98


def test_false_probe_past_the_last_level():
    """It was read behind the end of the codebook."""
    from intentlane.llm.lm_bloom import Model, code_of
    model = Model(10, 3, np.array([0.0, 1.0, 2.0]), np.array([0.0, 1.0]), np.array([0.0, 0.5, 0.5]))
    got = model.log10(code_of(np.array([2, 2]), np.array([1, 1]), np.array([1, 2])))
    assert got[0] == got[1]

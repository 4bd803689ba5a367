"""The whole pipeline on planted documents."""

import random

import corpus_pipeline as P


def test_planted_documents(spark, tmp_dir):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    passage = lambda n: " ".join(word() for _ in range(n))
    item = passage(40)
    rows = [(i, passage(60), "aa", f"s{i % 3}") for i in range(120)]
    rows += [(200, rows[5][1], "aa", "s1"), (201, rows[6][1].upper(), "aa", "s2"),        # copies
             (202, passage(30) + " " + item + " " + passage(30), "aa", "s0"),              # benchmark item
             (203, "123 456", "aa", "s0"), (204, None, None, None), (205, passage(50), None, None)]
    rows += [(300 + i, passage(40) + " zorpel " + passage(5), "aa", "s0") for i in range(60)]  # toxic
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars")
    df.write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 300)) for r in rows], "doc_id bigint, quality int, toxic int") \
        .write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    got = P.run(spark, tmp_dir).collect()
    assert sorted(r["doc_id"] for r in got) == [*range(120), 205]
    size = sum(r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - sum({r["source"]: r["target"] for r in got}.values())) <= 4
    assert sum({r["source"]: r["source_size"] for r in got}.values()) == size
    assert [n for n, _ in P.STAGES] == ["toxicity", "language_id", "simhash_dedup", "decontaminate", "mix"]

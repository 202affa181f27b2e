import random

import corpus_pipeline
from kartoteka.llm.minhash import near_duplicates
from tests.llm import clashing


def documents(spark, tmp_path):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = text(90), text(120)
    rows = [(i, text(rng.randint(5, 300)), "aa", "abc"[i % 3]) for i in range(60)]
    rows += [(100, base, "aa", "a"), (101, base, "aa", "b"), (102, base + " tail", "aa", "b"), (103, "123 456", "bb", "a"), (104, None, "aa", None), (105, "", None, "c")]
    rows += [(110, text(30) + " " + shared + " " + text(30), "aa", "a"), (111, text(40) + " " + shared + " " + text(20), "bb", "b")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return df, shared


def test_stages(spark, tmp_path):
    docs, shared = documents(spark, tmp_path)
    columns, step = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns
        step[name] = docs.collect()
    ids = {name: [r.doc_id for r in rows] for name, rows in step.items()}
    assert not {103, 104, 105} & set(ids["language_id"]) and {0, 100, 110} <= set(ids["language_id"])
    assert set(ids["language_id"]) - set(ids["near_dedup"]) == {101, 102}
    assert sorted(ids["near_dedup"]) == sorted(ids["repeat_removal"])
    cut = {r.doc_id: r for r in step["repeat_removal"]}
    assert shared[50:200] not in cut[110].text and shared[50:200] not in cut[111].text and cut[110].n_chars == len(cut[110].text)
    assert set(ids["mixing"]) <= set(ids["repeat_removal"]) and max(map(ids["mixing"].count, ids["mixing"])) <= 4
    packed = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(ids["mixing"])


def test_run_and_empty_table(spark, tmp_path):
    documents(spark, tmp_path / "full")
    got = corpus_pipeline.run(spark, str(tmp_path / "full"))
    assert got.count() > 0
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_short_words_repeat(spark):
    """A passage of 51 words and 260 bytes goes, one of 50 words stays."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage, less = (" ".join(word(4 + (i < extra)) for i in range(n)) for n, extra in ((51, 6), (50, 0)))
    assert len(passage) == 260
    own = [" ".join(word(5) for _ in range(40)) for _ in range(8)]
    texts = [f"{own[2 * i]} {(passage, passage.replace(' ', '  '), less, less)[i]} {own[2 * i + 1]}" for i in range(4)]
    docs = spark.createDataFrame([(i, t, "aa", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.repeat_removal(spark, docs, "").collect()}
    assert [got[i].text.split() for i in (0, 1)] == [f"{own[2 * i]} {own[2 * i + 1]}".split() for i in (0, 1)]
    assert [got[i].text for i in (2, 3)] == texts[2:] and all(r.n_chars == len(r.text) for r in got.values())


def test_one_row_of_each_group(spark):
    """Repeated rows, tied ids and null ids: one row of a group stays, and repeat_removal leaves its text."""
    rng = random.Random(3)
    text = lambda: " ".join(f"word{rng.randint(0, 500)}" for _ in range(120))
    t = [text() for _ in range(6)]
    rows = [(1, t[0], "a")] * 3  # repeated rows
    rows += [(2, t[1], "a"), (2, t[1] + " tail", "b"), (2, t[2], "a")]  # one id: two near copies and a text of its own
    rows += [(None, t[3], "a"), (None, t[3], "b"), (None, t[3], None), (None, t[4], "a")]  # null ids
    rows += [(3, t[4], "a"), (None, t[5], "a"), (None, t[5], "a"), (9, "", "a"), (9, "", "a")]
    docs = spark.createDataFrame([(i, x, "aa", s, len(x)) for i, x, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "").cache()
    got = [(r.doc_id, r.text.removesuffix(" tail")) for r in kept.collect()]
    want = [(1, t[0]), (2, t[1]), (2, t[2]), (None, t[3]), (3, t[4]), (None, t[5]), (9, ""), (9, "")]
    assert sorted(got, key=str) == sorted(want, key=str) and kept.columns == docs.columns
    whole = [r.text for r in corpus_pipeline.repeat_removal(spark, kept, "").collect()]
    assert sorted(x.removesuffix(" tail") for x in whole) == sorted(x for _, x in want)


def test_clashing_columns(spark, tmp_path):
    """Extra columns under names of their own kind change nothing and pass every stage but the last."""
    docs, _ = documents(spark, tmp_path)
    extra = clashing(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, extra = stage(spark, docs, "").cache(), stage(spark, extra, "").cache()
        assert extra.columns[: len(docs.columns)] == docs.columns and len(extra.columns) > 50
        got = sorted(extra.select(*docs.columns).collect(), key=str)
        assert got == sorted(docs.collect(), key=str), name
        assert extra.filter("removed_spans is null or _kept <> 3").count() in (0, extra.count())
    pieces = lambda df: {(r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect() if r.start % 2048 == 0 and r.length == 2048}
    assert pieces(corpus_pipeline.packing(spark, extra, "")) == pieces(corpus_pipeline.packing(spark, docs, ""))


def test_inner_tables_go(spark, tmp_path):
    from kartoteka.llm.common import shared_folder

    documents(spark, tmp_path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    tables = lambda: {f.getPath().getName() for f in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop) if f.getPath().getName().startswith("table-")}
    before = tables()
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert tables() == before and rows.count() > 0

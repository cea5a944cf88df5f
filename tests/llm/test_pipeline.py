"""The stages on a small corpus with planted cases; the queries' contracts."""

import random

import pytest

import corpus_pipeline
from threadloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = {k: draw(rng.randrange(30, 120)) for k in range(60)}
    item, passage = draw(45), draw(70)
    rows[100] = rows[1]  # exact copy
    rows[101] = rows[2] + " end"  # near copy
    rows[102] = draw(30) + " " + item + " " + draw(30)  # leak
    rows[103], rows[104] = (draw(40) + " " + passage + " " + draw(40) for _ in range(2))
    rows |= {105: None, 106: "123 ...", 107: ""}
    docs = [(k, t, "en", f"s{k % 4}" if k % 7 else None, len(t) if t else 0) for k, t in rows.items()]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, passage


def test_stages(spark, corpus):
    path, rows, passage = corpus
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    gone = lambda a, b: set(a) - set(b)
    assert gone(rows, seen["language"]) == {105, 106, 107}
    assert gone(seen["language"], seen["near_duplicates"]) == {100, 101}
    assert gone(seen["near_duplicates"], seen["repeated_passages"]) == set()
    cut = seen["repeated_passages"]
    assert passage in cut[103].text and passage not in cut[104].text and cut[104].n_chars == len(cut[104].text)
    assert all(cut[k].text == rows[k] for k in range(60))
    assert gone(cut, seen["decontamination"]) == {102}
    mix = seen["mixing"]
    assert set(mix) == set(seen["decontamination"]) and sum(r.taken for r in mix.values()) > 0
    assert all(r.taken <= 3 * r.size for r in mix.values())


def test_run_returns_the_last_stage(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert got.count() == 62 and {"doc_id", "taken", "position"} <= set(got.columns)


def test_stages_of_an_empty_table(spark, corpus):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus[0])
        assert docs.count() == 0


def test_one_query_for_each_number():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES if q.startswith("op")) == list(range(1, 14))


def test_near_duplicates_of_rows_without_an_id_of_their_own(spark, corpus):
    """Null and repeated ids: a row goes only where its text is near that of a row that stays."""
    path, texts, _ = corpus
    rows = [(None, texts[k]) for k in range(5)] + [(7, texts[k]) for k in (5, 6)] + [(8, texts[7]), (7, texts[7] + " end")]
    rows += [(9, texts[8]), (9, texts[8]), (None, texts[9]), (3, texts[9]), (None, texts[10]), (None, texts[10] + " end"), (10, None), (10, ""), (None, None)]
    docs = [(k, t, "en", "s", len(t) if t else 0) for k, t in rows]
    stay = None
    for parts in (1, 3, 4):
        got = corpus_pipeline.near(spark, spark.createDataFrame(docs[::-1] if parts == 3 else docs, DOCS).repartition(parts), path)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
        assert stay in (None, left)
        stay = left
    ends = [r for r in stay if r in ((None, texts[10]), (None, texts[10] + " end"))]
    want = rows[:7] + [rows[8], rows[9], rows[11], *ends, *rows[15:]]
    assert len(ends) == 1 and stay == sorted(want, key=repr)


def test_extra_columns_of_any_name_pass_through(spark, corpus):
    path, rows, _ = corpus
    names = ["msg_id", "score", "lang_mix", "matches", "n_items", "n_words", "n_removed", "_row", "_place", "_doc", "contaminated", "kept_text", "a b"]
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", *[f"concat('{k}', doc_id) `{n}`" for k, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() == 62
    for r in docs.collect():
        assert [r[n] for n in names] == [f"{k}{r.doc_id}" for k in range(len(names))]


def test_without_labels_all_texts_with_a_letter_stay(spark, corpus):
    docs = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "12 ..", None, "s", 5), (3, None, None, None, None), (4, "é", None, "s", 1)], DOCS)
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, corpus[0]).collect()} == {1, 4}


def test_stages_delete_what_earlier_ones_left(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    corpus_pipeline.near(spark, docs, corpus[0]).write.parquet(str(tmp_path / "near"))
    left = corpus_pipeline._LEFT[spark.sparkContext.applicationId]
    assert left
    before, docs = list(left), spark.read.parquet(str(tmp_path / "near"))
    corpus_pipeline.decontamination(spark, docs, corpus[0]).count()
    assert not set(before) & set(left)
    # a result that is still to be computed keeps its tables
    lazy = corpus_pipeline.near(spark, docs, corpus[0])
    assert corpus_pipeline.language(spark, lazy, corpus[0]).count() == lazy.count() - 3  # those without a letter

"""Specs, caps, filters, folds, sinks and parses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgap.functions import text as tx
from corpusgap.operators import chunks, ingest, ranking, syntax
from corpusgap.sources import corpora, tables
from corpusgap.sources.specs import CORPORA, corpus_spec

LONG = "word " * 40


def raw_rows(spark, spec):
    """One admissible row in the raw shape of a corpus."""
    back = {new: old for old, new in spec.columns.items()}
    row = {c: "meta" for c in spec.dropped}
    row[back.get("text", "text")] = LONG
    if not spec.summary_parts:
        row[back.get("summary", "summary")] = "a summary"
    df = spark.createDataFrame([row])
    if spec.list_field:
        df = df.withColumn(spec.list_field, F.array(F.lit(LONG), F.lit("tail")))
    return df.withColumn("split", F.lit("train"))


@pytest.mark.parametrize("name", sorted(CORPORA))
def test_every_registered_corpus_reads_from_its_folder(spark, tmp_path, name):
    spec = corpus_spec(name)
    tables.write_splits(raw_rows(spark, spec), f"{tmp_path}/{spec.path}")
    row = corpora.load_corpus(spark, name, str(tmp_path)).collect()[0]
    assert (row["domain"], row["split"]) == (name, "train")
    assert row["text"].startswith("word")
    assert row["summary"] == ("meta \n meta \n meta" if name == "aclsum" else "a summary")
    if name == "legalsum":
        assert row["text"].endswith(" tail")


def test_unknown_corpus_and_missing_column_fail(spark):
    with pytest.raises(ValueError, match="unknown corpus"):
        corpus_spec("nothing")
    with pytest.raises(ValueError, match="not found"):
        ingest.drop_columns(spark.range(1), ["x"])


def test_csv_by_split(spark, tmp_path):
    df = spark.createDataFrame([(' quoted "x"\nline ', LONG)], "summary string, text string")
    path = tables.write_csv(df, str(tmp_path / "csv"))
    read = corpora.scan_csv(spark, {"test": path, "train": [path]}, df.schema)
    assert sorted(r["split"] for r in read.collect()) == ["test", "train"]
    assert {r["summary"] for r in read.collect()} == {' quoted "x"\nline '}
    loaded = corpora.load_corpus(spark, "arxiv", data_files=path, schema="abstract string, article string")
    assert loaded.columns == corpora.CANONICAL


def test_admissible_limits(spark):
    rows = [
        ("ok", "x" * 9, "yyyy"), ("short", "x" * 8, "yyyy"), ("long", "x" * 1000, "y"),
        ("almost", "x" * 999, "y"), ("verbatim", "abcdefghij", "abc"), ("none", None, "y"),
        ("nosum", "xxx", None), ("same", "abc", "abc"),
    ]
    df = spark.createDataFrame(rows, "k string, text string, summary string")
    assert {r["k"] for r in ingest.admissible(df).collect()} == {"ok", "almost"}
    assert {r["k"] for r in ingest.admissible(df, 10).collect()} == {"almost"}


def test_train_is_capped_before_the_filter_and_test_stays(spark):
    rows = [("d", "train", i, None if i == 0 else LONG, "s u m") for i in range(5)]
    rows += [("d", "test", i, LONG, "s u m") for i in range(5, 9)]
    df = spark.createDataFrame(rows, "domain string, split string, doc_id bigint, text string, summary string")
    kept = ingest.admissible(ingest.cap_train(df, 2)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in kept} == {"train": 1, "test": 4}
    assert ingest.preview(df).count() == 8


def test_first_n_and_ranks_with_one_group_holding_most_rows(spark):
    ids = spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 10).cast("string"))).alias("g"),
        (F.col("id") * F.col("id") % 100003).alias("x"),
    ).dropDuplicates(["x"])
    want = {}
    for r in ids.collect():
        want.setdefault(r["g"], []).append(r["x"])
    want = {g: {x: i + 1 for i, x in enumerate(sorted(xs))} for g, xs in want.items()}
    ranked = ranking.exact_rank(ids, ["g"], "x").collect()
    assert len(ranked) == ids.count()
    assert all(want[r["g"]][r["x"]] == r["rank"] for r in ranked)
    first = ranking.first_n(ids, ["g"], "x", 1500).collect()
    assert {(r["g"], r["x"]) for r in first} == {(g, x) for g, m in want.items() for x, i in m.items() if i <= 1500}
    top = ranking.top_n(ids, ["g"], [F.col("x").desc()], "x", 3).collect()
    assert {(r["g"], r["rank"]): r["x"] for r in top}[("hot", 1)] == max(want["hot"])


def test_text_pieces_and_strip(spark):
    df = spark.createDataFrame([(1, "\n abcdefg\t"), (2, " \n"), (3, "")], "doc_id int, text string")
    got = chunks.parser_chunks(df, 3).orderBy("chunk_no").collect()
    assert [(r["doc_id"], r["chunk"]) for r in got] == [(1, "abc"), (1, "def"), (1, "g")]
    long = spark.createDataFrame([("w " * 4001,), ("w " * 4000,)], "text string")
    sizes = [r[0] for r in long.select(F.length(tx.embedding_input(F.col("text")))).collect()]
    assert sorted(sizes) == [4000, 8000]


def test_tree_depths(spark):
    def tokens(sent, heads, start=0):
        return [("d", "test", 1, sent, start + i, start + h) for i, h in enumerate(heads)]

    rows = (tokens(0, [0]) + tokens(1, [0, 0, 1, 2, 3], 10) + tokens(2, [2, 2, 2])
            + tokens(3, list([0] + list(range(300)))) + tokens(4, [1, 0]) + tokens(5, [0, 9]))
    df = spark.createDataFrame(rows, "domain string, split string, doc_id bigint, sent_id int, i int, head int")
    got = {r["sent_id"]: (r["is_tree"], r["tree_depth"]) for r in syntax.sentence_depths(df).collect()}
    assert got == {0: (True, 1), 1: (True, 5), 2: (True, 2), 3: (True, 301), 4: (False, None), 5: (False, None)}
    row = syntax.learning_difficulty(df.where("sent_id < 2")).first()
    assert row["learning_difficult"] == pytest.approx(0.7 * 4 / 6 + 0.3 * 5)


def test_read_or_compute_runs_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    path = tables.run_folder(str(tmp_path), "run1", "t")
    assert tables.read_or_compute(spark, path, compute).count() == 3
    assert tables.read_or_compute(spark, path, compute).count() == 3
    assert len(calls) == 1


def test_score_sheet_is_read_by_column_name(spark, tmp_path):
    sheet = spark.createDataFrame([("a", "test", 0.5, "base")], "ds string, split string, rouge1 double, model string")
    path = tables.write_csv(sheet, str(tmp_path / "scores"))
    row = tables.read_scores(spark, path, metrics=["rouge1"]).first()
    assert row.asDict() == {"ds": "a", "split": "test", "model": "base", "rouge1": 0.5}


def test_sentences_in_pieces_and_with_gaps_keep_their_trees(spark):
    """Tokens of a sentence far apart, beyond bytes, from 2 ** 40 on, without head or position; keys that are null."""
    rng = np.random.default_rng(1)
    heads = [0, *[int(rng.integers(0, i)) for i in range(1, 500)]]

    def depth(i):
        return 1 if heads[i] == i else 1 + depth(heads[i])

    rows = [("d", "test", None, s, start + i, start + h) for s, start in ((0, 0), (1, 1 << 40)) for i, h in enumerate(heads)]
    rows += [("d", None, 1, 2, i, 0) for i in range(200)] + [("d", "test", 1, 3, 0, 0), ("d", "test", 1, 3, 1, None)]
    rows += [("d", "test", 1, 4, None, 0), ("d", "test", 1, 4, 0, 0), ("d", "test", 1, 5, None, None)]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    df = spark.createDataFrame(rows, "domain string, split string, doc_id bigint, sent_id int, i bigint, head bigint").repartition(3)
    found = syntax.sentence_depths(df)
    got = {r["sent_id"]: (r["tokens"], r["length"], r["is_tree"], r["tree_depth"]) for r in found.collect()}
    tree = (500, sum(i - h for i, h in enumerate(heads)), True, max(depth(i) for i in range(500)))
    assert got == {0: tree, 1: tree, 2: (200, sum(range(200)), True, 2), 3: (2, 0, False, None), 4: (2, 0, False, None), 5: (1, None, False, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.index("Aggregate") < plan.rindex("MapInArrow")  # tokens are gathered before the shuffle

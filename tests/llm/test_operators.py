"""Each operator on small tables: against brute force, and in the cases that its docstring lists."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgap.llm import (
    chat, components, decontamination, jaccard_join, language, licenses, line_dedup, mixing, quality, token_shards, toxicity,
)
from corpusgap.llm.common import BATCH, Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, key string, row_hash string, id_hash int, root int, doc int, n int"


def docs_of(spark, texts, **columns):
    """Documents with extra columns that have the names of inner ones."""
    rows = []
    for i, text in enumerate(texts):
        at = {c: v[i] for c, v in columns.items()}
        rows.append((at.get("doc_id", i), text, at.get("lang"), at.get("source"), "k", "h", 1, 2, 3, 4))
    return spark.createDataFrame(rows, SCHEMA)


def words(n, start=0):
    return " ".join(f"w{i}x" for i in range(start, start + n))


ODD = [None, "", "   \n\t ", "!!!", "one", "a\nb\na\n", "é" * 50, words(3000)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (7, 8), (9, 9), (8, 6), (20, 21)] + [(100 + i, 101 + i) for i in range(40)]
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t"))
    found = {r["node"]: r["root"] for r in got.collect()}
    assert found[1] == found[2] == found[3] == 1 and found[7] == found[8] == 6 and found[21] == 20
    assert all(found[100 + i] == 100 for i in range(41)) and 9 not in found
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "t")).count() == 0


# 1 lines

def line_brute(docs, size=9, threshold=0.8):
    def shingles(x):
        return frozenset(x[i:i + size] for i in range(len(x) - size + 1)) if len(x) >= size else frozenset([x])

    at = [(i, j, x.strip(" \t\r\x0b\f")) for i, t in docs for j, x in enumerate((t or "").split("\n"))]
    at = [a for a in at if a[2]]
    sets = {x: shingles(x) for x in {a[2] for a in at}}
    up = {x: x for x in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        k = len(sets[a] & sets[b])
        if k >= threshold * (len(sets[a]) + len(sets[b]) - k):
            up[top(a)] = top(b)
    first = {}
    for i, j, x in at:
        first[top(x)] = min(first.get(top(x), (i, j)), (i, j))
    gone = defaultdict(list)
    for i, j, x in at:
        if first[top(x)] != (i, j):
            gone[i].append(j)
    return gone


def test_lines_against_brute_force(spark):
    base = [" ".join(f"word{(i * 7 + k) % 97}" for k in range(30)) for i in range(5)]
    texts = []
    for i in range(60):
        own = base[i % 5].split()
        own[i % 30] = f"other{i}"
        texts.append("\n".join([" ".join(own), base[(i + 1) % 5], f"short {i % 3}", "", f"line of its own number {i * i}"]))
    docs = docs_of(spark, [*texts, *ODD])
    rows = line_dedup.per_document(line_dedup.decide(docs)).collect()
    want = line_brute([(i, t) for i, t in enumerate([*texts, *ODD])])
    assert len(rows) == len(texts) + len(ODD)
    assert {r["doc_id"]: r["dropped"] for r in rows if r["dropped"]} == {i: sorted(x) for i, x in want.items() if x}


def test_lines_by_builtin_functions_alone(spark, monkeypatch):
    """No Python workers, whichever way a line is signed and compared; near lines of different ways are found."""
    from pyspark.sql import DataFrame

    for owner, name in [(DataFrame, "mapInArrow"), (DataFrame, "mapInPandas"), (F, "pandas_udf"), (F, "udf")]:
        monkeypatch.setattr(owner, name, None)
    monkeypatch.setattr(line_dedup, "LIMIT", 2)  # buckets of more lines meet by their rarest shingles
    phrase, many = "ha hi ho hu he ", words(170, 5000)
    texts = [
        words(26), words(26)[:-1], words(23), words(23) + " w23x",  # around MANY words
        many, many.replace("w5100x", "w51oox"), words(149, 7000), words(150, 7000),  # around DENSE words
        phrase * 3, phrase * 60, "漢字" * 40 + "かな" * 30, "漢字" * 40 + "かな" * 31, "http://a.b/" + "q1w2e3r4t5y6" * 9 + "zz", "http://a.b/" + "q1w2e3r4t5y6" * 9 + "zy",
        "short line", "short line.", "tiny", "tiny", "no\tblanks\tin\tthis\tline\tbut\ttabs", "no\tblanks\tin\tthis\tline\tbut\ttab",
        *[f"{words(30, 9000)} {i:07d}" for i in range(8)], "🙂🙃" * 9, "🙂🙃" * 8 + "🙂"]
    want = line_brute(list(enumerate(texts)))
    rows = line_dedup.per_document(line_dedup.decide(docs_of(spark, texts))).collect()
    assert {r["doc_id"]: r["dropped"] for r in rows if r["dropped"]} == {i: sorted(x) for i, x in want.items() if x}
    assert sum(map(len, want.values())) >= 15


def test_lines_of_many_words_are_signed_by_all_shingles(spark):
    """Near lines whose shingles agree and whose words differ: the first letter of every seventh word is another one."""
    rng = np.random.default_rng(5)
    texts = []
    for i in range(40):
        own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxy"), 11)) for _ in range((42, 84, 168, 224)[i % 4])]
        texts += [" ".join(own), " ".join("z" + x[1:] if k % 7 == 3 else x for k, x in enumerate(own))]
    want = line_brute(list(enumerate(texts)))
    assert {i: list(x) for i, x in want.items()} == {2 * i + 1: [0] for i in range(40)}
    rows = line_dedup.per_document(line_dedup.decide(docs_of(spark, texts))).collect()
    assert {r["doc_id"]: r["dropped"] for r in rows if r["dropped"]} == {i: sorted(x) for i, x in want.items()}


def test_lines_of_few_shingles_meet_those_of_more(spark):
    """Sizes around those at which lines are signed by bins, by permutations and in both ways; a long line may have few shingles."""
    rng = np.random.default_rng(6)
    texts = []
    for n in range(6, 160, 2):
        line = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäß"), n + 8))
        few = max(1, n // 12)
        texts += [line, line + "".join(rng.choice(list("0123456789"), few)), line[few:]]
    for n in (12, 30, 45, 60, 75, 90):
        piece = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
        texts += [piece * 3, piece * 20 + piece[:3], piece[:9] + "-" + piece * 40]
    want = line_brute(list(enumerate(texts)))
    rows = line_dedup.per_document(line_dedup.decide(docs_of(spark, texts))).collect()
    assert {r["doc_id"]: r["dropped"] for r in rows if r["dropped"]} == {i: sorted(x) for i, x in want.items() if x}
    assert sum(map(len, want.values())) >= 150


def test_lines_false_pairs_stop_at_the_sample(spark):
    """Samples stop most pairs of lines that have no shingle in common, short lines too, and no pair at the threshold."""
    apart = [" ".join(f"{(i * 7919 + k * 104729) % 1000003:06d}" for k in range(6)) for i in range(30)]
    near = [line[:-4] + "z" * 2 for line in apart]
    rows = spark.createDataFrame([(i, line) for i, line in enumerate([*apart, *near])], "key long, line string")
    tokens = rows.select("key", line_dedup.shingles(F.col("line")).alias("tokens"))
    told = tokens.select("key", F.struct(F.size("tokens").alias("n"), F.filter(
        "tokens", lambda t: t.bitwiseAND(line_dedup.SAMPLE - 1) == 0).alias("sample")).alias("told"))
    pairs = told.select(F.col("key").alias("a"), F.col("told").alias("x")).join(told.select(F.col("key").alias("b"), F.col("told").alias("y")), F.expr("a < b"))
    left = {(r["a"], r["b"]) for r in pairs.where(line_dedup._alike(0.8)).select("a", "b").collect()}
    same = {(i, i + 30) for i in range(30)}
    assert same <= left and len(left - same) <= 0.5 * (pairs.count() - 30)


def test_lines_edges(spark):
    docs = docs_of(spark, ["same line here\nsame line here", "same line here", None, "same line here"], doc_id=[4, 3, 1, None])
    decided = line_dedup.decide(docs)
    texts = {r["doc_id"]: r["text"] for r in line_dedup.clean(docs, decided).collect()}
    assert texts == {4: "", 3: "same line here", 1: None, None: ""}
    assert line_dedup.clean(docs, decided).columns == docs.columns
    assert line_dedup.per_document(line_dedup.decide(docs.limit(0))).count() == 0
    twice = line_dedup.per_document(line_dedup.decide(docs_of(spark, ["x y", "x y"], doc_id=[1, 1])))
    assert twice.count() == 2


def test_lines_of_identical_rows(spark):
    """Each component keeps one line, also among rows that nothing tells apart."""
    same = "x y\n\nsecond line of the text"
    docs = docs_of(spark, [same, same, same, "x y\nlast", "no copy"], doc_id=[1, 1, 1, 5, 6])
    decided = line_dedup.decide(docs)
    rows = sorted((r["doc_id"], r["n_dropped"], r["dropped"]) for r in line_dedup.per_document(decided).collect())
    assert rows == [(1, 0, []), (1, 2, [0, 2]), (1, 2, [0, 2]), (5, 1, [0]), (6, 0, [])]
    left = sorted((r["doc_id"], r["text"]) for r in line_dedup.clean(docs, decided).collect())
    assert left == [(1, ""), (1, ""), (1, same), (5, "last"), (6, "no copy")]


def test_lines_with_ids_that_are_no_numbers(spark):
    docs = docs_of(spark, ["equal line of text", "equal line of text", "other"]).withColumn("doc_id", F.concat(F.lit("id-"), "doc_id"))
    rows = {r["doc_id"]: r["n_dropped"] for r in line_dedup.per_document(line_dedup.decide(docs)).collect()}
    assert sorted(rows) == ["id-0", "id-1", "id-2"] and sum(rows.values()) == 1 and rows["id-2"] == 0


# 2 decontamination

def words_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated_brute(texts, items, size=10):
    out = []
    for text in texts:
        w, hit, ids = words_of(text), set(), set()
        for item, t in items:
            v = words_of(t)
            n = min(size, len(v))
            for window in {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else ():
                for i in range(len(w) - n + 1):
                    if tuple(w[i:i + n]) == window:
                        hit |= set(range(i, i + n))
                        ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((len(w), len(hit), len(ids), digest, bool(hit)))
    return out


def test_decontamination_against_brute_force(spark):
    items = [(1, words(14)), (2, "Short One!"), (3, None), (4, ""), (10, words(30, 500)), (11, words(30, 500)), (5, "the the the the")]
    texts = [*ODD, "x " + words(12) + " y", words(9), words(10).upper(), "short one short ONE", "the the the the the",
             words(40, 490) + " z " + words(40, 490), "É " + words(11) + " é", words(10).replace(" ", "--")]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
           for r in decontamination.decontaminate(docs, bench).collect()}
    assert [got[i] for i in range(len(texts))] == contaminated_brute(texts, items)
    kept = decontamination.keep_clean(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i][4]} and kept.columns == docs.columns


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(None, words(12)), (1, words(12))], "item_id bigint, text string")
    same = docs_of(spark, [words(12), words(12), "no"], doc_id=[7, 7, None])
    rows = decontamination.decontaminate(same, bench).collect()
    assert sorted((r["doc_id"] or 0, r["n_items"]) for r in rows) == [(0, 0), (7, 1), (7, 1)]
    assert decontamination.decontaminate(same, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontaminate(same.limit(0), bench).count() == 0


def test_decontamination_of_a_very_long_text_with_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_TERMS", 0)
    monkeypatch.setattr(decontamination, "MAX_HIT_DOCS", 0)
    items = [(1, words(25, 7)), (2, "lone item")]
    texts = [words(150_000), words(30, 5), "a Lone  ITEM b"]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontamination.decontaminate(docs, bench).collect()}
    assert got == {0: (150_000, 25, 1), 1: (30, 25, 1), 2: (4, 2, 1)}
    assert decontamination.keep_clean(docs, bench).count() == 0


def test_proximity(spark):
    docs = docs_of(spark, ["alpha beta gamma", "alpha x beta y gamma", "alpha x x x x x beta gamma", "gamma beta"])
    phrases = spark.createDataFrame([("alpha beta gamma",)], "phrase string")
    near = lambda slack: {r["doc_id"] for r in decontamination.proximity_matches(docs, phrases, slack).collect()}
    assert near(0) == {0} and near(2) == {0, 1} and near(9) == {0, 1, 2}


# 3 quality

def test_quality_counts():
    text = "# a | b\n\nx y\nx y\n one two three four five one two three four five z"
    n, chars, symbols, dup, repeated, _ = quality.measures(text)
    assert (n, symbols, dup) == (18, 2, 1) and chars == len(re.sub(r"[\x20\x09-\x0D]", "", text))
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i:i + 5])].append(i)
    assert repeated == len({j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 5)})
    assert quality.measures(None)[:5] == (0, 0, 0, 0, 0) and quality.measures("a " * 6)[4] == 6


def test_quality_verdicts(spark):
    good = [" ".join(f"fine{(i + k * k) % 41}" for k in range(1, 40)) + f" end{i}" for i in range(20)]
    bad = [" ".join(f"junk{(i + k * k) % 43}" for k in range(1, 40)) + f" end{i}" for i in range(20)]
    texts = [*good, *bad, *ODD]
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    rows = {r["doc_id"]: r for r in quality.judge(docs_of(spark, texts), labels).collect()}
    assert len(rows) == len(texts)
    clean = [i for i in range(40) if not rows[i]["base_failed"]]
    assert clean and all(rows[i]["kept"] == (i < 20) for i in clean)
    assert all(rows[40 + i]["base_failed"] for i in range(6))
    nothing = quality.judge(docs_of(spark, good), labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in nothing)
    assert quality.judge(docs_of(spark, []), labels).count() == 0


# 4 licenses

def test_licenses(spark):
    texts = ["Licensed under CC BY-NC 4.0.\nText.", "Released under the MIT License. More. Released under the MIT License!",
             "This program is free software; you can redistribute it and/or modify it\nunder the terms of the GNU General Public License, version 3.",
             "Some licensed thing here.", *ODD]
    rows = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert [rows[i]["main_license"] for i in range(4)] == ["CC-BY-NC-4.0", "MIT", "GPL-3.0", "UNKNOWN"]
    assert rows[1]["licenses"] == "MIT,MIT" and rows[2]["sentence_ids"] == "GplFree GplTerms3" and rows[3]["n_unmatched"] == 1
    assert all(rows[4 + i]["main_license"] is None and rows[4 + i]["licenses"] == "" for i in range(len(ODD)))
    assert rows[4]["n_sentences"] == 0 and licenses.scan(docs_of(spark, [])).count() == 0


# 5 toxicity

def test_toxicity(spark):
    texts = [f"plain words number {i} " + words(30, i) + (" vile" if i % 4 == 0 else "") for i in range(200)]
    docs = docs_of(spark, [*texts, *ODD])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(200, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(rows) == 208 and all(rows[i]["predicted"] == int(i % 4 == 0) for i in range(200))
    assert rows[200]["score"] == rows[201]["score"] and all(0 <= r["score"] <= 1 for r in rows.values())
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    flags = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).where("h").collect()
    assert {r["doc_id"] for r in flags if r["doc_id"] < 200} == held
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.where("text like '%vile%'").count() == 0 and kept.count() == 158
    none = toxicity.learn(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


# 6 tokens

@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_slots_are_a_permutation(n):
    got = token_shards.slots(np.arange(n), n)
    assert sorted(got) == list(range(n)) and (n < 1000 or (got != token_shards.slots(np.arange(n), n, key=2)).any())


def test_tokens_round_trip(spark):
    texts = [*ODD, "a  b\n\n c", " lead", "it's 1,000 — ok", words(50), words(50), " x  y \x1fz", "a " * 100]
    docs = docs_of(spark, texts)
    rows = token_shards.write_order(docs, length=16, per_shard=8).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(r["byte_offset"] == r["slot"] % 8 * 32 and r["shard"] == r["slot"] // 8 and len(r["payload"]) == 32 for r in rows)
    coder, read = token_shards.Chunks().coder, defaultdict(list)
    for r in sorted(rows, key=lambda r: r["part"]):
        read[r["doc_id"]] += np.frombuffer(r["payload"], "<u2")[:r["n_tokens"]].tolist()
    assert {i for i, t in enumerate(texts) if t} == set(read)
    for i, ids in read.items():
        assert ids[-1] == token_shards.END and ids[:-1] == coder.encode_ordinary(texts[i]) and coder.decode(ids[:-1]) == texts[i]
    again = token_shards.write_order(docs, length=16, per_shard=8)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    assert token_shards.read_from(again, 5).first()["slot"] == 5
    assert token_shards.write_order(docs.limit(0)).count() == 0


def test_words_are_encoded_once_a_batch():
    """Ids of the whole text, whatever its white space; equal words cost one encoding."""
    odd = ["", " ", "\n", "a", "a b", " a b", "a b ", "a  b", "a \nb", "a\n b", "a\nb c\n\nd", "\na b", "a b\n", "a\tb c", "é 漢字 🙂", "a\xa0b c",
           "a\x1cb c", "x" * 50 + " b", "don't 12 ab"]
    chunks = token_shards.Chunks()
    want = {t: np.array(chunks.coder.encode_ordinary(t), "<u2").tobytes() for t in odd}
    assert chunks.encode(odd) == [want[t] for t in odd] and chunks.encode([]) == []
    for t in odd:
        assert chunks.encode([t]) == [want[t]]
    given = []

    class Counted:
        def encode_ordinary(self, text, coder=chunks.coder):
            given.append(text)
            return coder.encode_ordinary(text)

    chunks.coder = Counted()
    assert len(chunks.encode(["begin " + words(100)] * 30)) == 30
    assert sum(map(len, given)) < 2 * len(words(100))


def test_slots_follow_from_the_rows_alone(spark, tmp_path):
    """Other files, splits, orders and partitions, the same slots."""
    texts = [words(5 + i % 37, i) for i in range(300)] + [words(20)] * 5
    docs = docs_of(spark, texts, doc_id=[None, 2**60 + 1, *range(2, 305)])
    want = None
    for i, (files, split) in enumerate([(1, "128m"), (7, "8k"), (3, "20k")]):
        docs.repartition(files, F.rand(i)).write.parquet(f"{tmp_path}/{i}")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            read = spark.read.parquet(f"{tmp_path}/{i}")
            rows = token_shards.write_order(read, length=16, per_shard=32).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        got = {r["slot"]: (r["doc_id"], r["part"], r["n_tokens"], bytes(r["payload"])) for r in rows}
        want = want or got
        assert got == want and sorted(got) == list(range(len(rows)))
    assert {None, 2**60 + 1} <= {v[0] for v in want.values()}


def test_texts_are_tokenized_in_small_batches(spark):
    import pyarrow as pa

    texts = ["ab" * n for n in (300, 1, 0, 5000, 2, 3)] * 50
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})
    cut = list(token_shards.small([batch, batch.slice(0, 0)], 1000))
    assert [t for b in cut for t in b.column("text").to_pylist()] == texts
    assert len(cut) > 100 and all(b.num_rows <= 1 or sum(map(len, b.column("text").to_pylist())) <= 1000 for b in cut)

    # what crosses to Python is small too, while the table is written and not later
    docs, before = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), spark.conf.get(BATCH)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"range": [0], "rows": [b.num_rows]})

    for most, many in ((4000, True), (None, False)):
        written = Scratch(spark, "sizes").put_buckets(docs.mapInArrow(sizes, "range long, rows long"), "range", 1, batch_bytes=most)
        got = [r["rows"] for r in written.collect()]
        assert sum(got) == 300 and (len(got) > 20) == many
    assert spark.conf.get(BATCH) == before


def test_written_shards(spark, tmp_path):
    docs = docs_of(spark, [words(40, i) for i in range(60)])
    folder = f"{tmp_path}/out"
    manifest = token_shards.write_shards(docs, folder, length=16, per_shard=50).collect()
    total = sum(r["n"] for r in manifest)
    assert {r["total"] for r in manifest} == {total} and [r["first_slot"] for r in sorted(manifest)] == list(range(0, total, 50))
    assert token_shards.damaged(spark, folder).count() == 0
    left = [r["slot"] for r in token_shards.resume(spark, folder, 77).collect()]
    assert left == list(range(77, total))
    spark.read.parquet(f"{folder}/shards").where("slot <> 60").write.partitionBy("shard").parquet(f"{tmp_path}/bad/shards")
    spark.read.parquet(f"{folder}/manifest").write.parquet(f"{tmp_path}/bad/manifest")
    assert [r["shard"] for r in token_shards.damaged(spark, f"{tmp_path}/bad").collect()] == [1]


# 7 join

def shingle_set(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def join_brute(texts, threshold=0.8):
    classes = defaultdict(list)
    for i, t in enumerate(texts):
        if s := shingle_set(t):
            classes[s].append(i)
    up, links = {min(v): min(v) for v in classes.values()}, Counter()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(classes, 2):
        k = len(a & b)
        if k >= threshold * (len(a) + len(b) - k):
            x, y = top(min(classes[a])), top(min(classes[b]))
            up[max(x, y)] = min(x, y)
            links[a] += 1
            links[b] += 1
    out = {}
    for i, t in enumerate(texts):
        s = shingle_set(t)
        out[i] = (min(classes[s]), len(classes[s]), top(min(classes[s])), links[s]) if s else (i, 1, i, 0)
    return out


def near_texts():
    rng = np.random.default_rng(5)
    texts = []
    for g in range(6):
        base = [f"t{g}q{x}" for x in rng.integers(0, 400, 150)]
        for _ in range(40 if g == 0 else 6):
            own = list(base)
            for at in rng.integers(0, 150, rng.integers(0, 4)):
                own[at] = f"new{rng.integers(1000)}"
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("limit", [200, 5])
def test_join_against_brute_force(spark, limit):
    texts = [*near_texts(), *ODD, "one", "a b c", "A B c"]
    rows = jaccard_join.near_copies(docs_of(spark, texts), limit=limit, depth=2).collect()
    assert {r["doc_id"]: (r["text_id"], r["n_copies"], r["class_id"], r["n_links"]) for r in rows} == join_brute(texts)


def test_join_of_a_crowd_around_one_passage(spark):
    rng = np.random.default_rng(9)
    passage = words(80)
    texts = [passage + " " + words(int(k), 1000 * (i + 1)) for i, k in enumerate(rng.integers(6, 60, 70))]
    rows = jaccard_join.near_copies(docs_of(spark, texts), limit=5, depth=2).collect()
    want = join_brute(texts)
    assert len({w[2] for w in want.values()}) > 20
    assert {r["doc_id"]: (r["text_id"], r["n_copies"], r["class_id"], r["n_links"]) for r in rows} == want


def test_join_counts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    texts = near_texts()
    rows = jaccard_join.near_copies(docs_of(spark, texts)).collect()
    want = join_brute(texts)
    assert {r["doc_id"]: r["n_links"] for r in rows} == {i: w[3] for i, w in want.items()}


def test_keep_one(spark):
    texts = [words(60), words(60), words(60), None, "", words(60) + " x", words(20, 900)]
    docs = docs_of(spark, texts, doc_id=[2, 2, 5, None, 1, 0, None])
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [
        (False, 0, ""), (False, 0, words(20, 900)), (True, 0, words(60) + " x"), (True, 1, "")]
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


# 8 language

def test_language(spark):
    stems = {"en": "the of and ing", "de": "der die und ung", "fr": "le les et ment", "es": "el los y ción"}
    texts = [" ".join(f"{w}{(i * k) % 7}" for k in range(1, 12) for w in stems[x].split()) for i in range(30) for x in stems]
    langs = [x for _ in range(30) for x in stems]
    docs = docs_of(spark, [*texts, *ODD], lang=[*langs, *[None] * len(ODD)])
    model = language.learn(docs, ~language.held_out(F.col("doc_id")))
    rows = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert sum(rows[i]["lang_pred"] == x for i, x in enumerate(langs)) == len(langs)
    odd = [rows[len(texts) + i]["lang_pred"] for i in range(len(ODD))]
    assert odd[:4] == ["und"] * 4 and set(odd[4:]) <= set(stems) and all(0 <= r["score"] <= 1 for r in rows.values())
    none = language.learn(docs.where("false"), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}
    one = language.learn(docs.where("lang = 'en'"), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(docs, one).collect()} == {"und", "en"}


# 9 mixing

def test_targets():
    got = mixing.targets([100.0, 100.0, 100.0, 10.0])
    assert max(g / s for g, s in zip(got, [100, 100, 100, 10])) <= 2 and math.isclose(sum(got), 465)
    assert mixing.targets([]) == [] and mixing.targets([0.0, 10.0]) == [0.0, 15.0]


def test_mix(spark):
    texts = [words(1 + (i * 37) % 90) for i in range(400)] + [None, "", "one"]
    sources = [("a", "b", "c", None)[i * i % 11 % 4] for i in range(len(texts))]
    docs = docs_of(spark, texts, source=sources)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts) and all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in rows)
    sums = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        sums[r["source"]][0] += r["size"]
        sums[r["source"]][1] += r["taken"]
        sums[r["source"]][2] = r["target"]
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    assert [sums[s][2] for s in order] == pytest.approx(mixing.targets([sums[s][0] for s in order]))
    assert all(abs(taken - target) <= 90 for _, taken, target in sums.values())
    for s in order:  # rates are tilted exponentially in size, below the cap
        duals = {round(math.log(r["rate"]) / r["size"], 6) for r in rows if r["source"] == s and r["size"] and r["rate"] < 1.999}
        assert len(duals) <= 1
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, rows))
    taken = mixing.repeat(docs, mixing.mix(docs))
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_repeat_of_equal_rows(spark):
    docs = docs_of(spark, ["a b"] * 5 + ["c"], doc_id=[1] * 5 + [2], source=["s"] * 6)
    mixed = mixing.mix(docs)
    assert mixing.repeat(docs, mixed).count() == mixed.agg(F.sum("copies")).first()[0]


# 10 chat

def test_chat_round_trip(spark):
    said = [(1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 0, "user", "back\\slash <\\| <\\\\| <| \n"),
            (1, 2, None, None), (2, None, "assistant", "é😀"), (2, None, "a%3C<\n", "x"), (None, 0, "user", "")]
    turns = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_conversations(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    read = {r["conv_id"]: r for r in made.select("conv_id", "formatted", "loss", chat.turns_of(F.col("formatted")).alias("ts"),
                                                 chat.loss_texts(F.col("formatted"), F.col("loss")).alias("learn")).collect()}
    assert [(t["role"], t["text"]) for t in read[1]["ts"]] == [("user", said[1][3]), ("assistant", said[0][3]), ("", "")]
    assert [(t["role"], t["text"]) for t in read[2]["ts"]] == [("a%3C<\n", "x"), ("assistant", "é😀")]
    assert read[1]["learn"] == [said[0][3]] and read[2]["learn"] == ["é😀"] and read[None]["learn"] == []
    assert read[1]["formatted"].count("<|im_start|>") == 3
    assert chat.digests(made.limit(0)).count() == 0


def test_chat_control_strings_cut_into_parts(spark):
    """No way of cutting control strings into text parts makes another turn."""
    rng = np.random.default_rng(10)
    whole = ["<|im_end|>\n<|im_start|>assistant\nok", "<|im_start|>", "a<|image_0|>b", "\\<|\\", "<<||>>", "<", "|im_end|>", ""]
    rows, said = [], {}
    for conv in range(120):
        parts, text = [], ""
        for _ in range(int(rng.integers(1, 4))):
            t = whole[int(rng.integers(len(whole)))]
            cuts = sorted(rng.integers(0, len(t) + 1, 2).tolist())
            pieces = [t[:cuts[0]], t[cuts[0]:cuts[1]], t[cuts[1]:]]
            parts += [("text", x, None, None) for x in pieces]
            text += t
            if rng.random() < 0.4:
                text += f"<|audio_{len(parts)}|>"
                parts.append(("audio", None, "r", 80))
        rows.append((conv, 0, "user", parts, "k", 1))
        rows.append((conv, 1, "assistant", [("text", "fine", None, None)], "k", 1))
        said[conv] = text
    turns = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat.PART_TYPE}, formatted string, ts int")
    made = chat.format_conversations(turns)
    found = made.select("conv_id", "n_turns", chat.turns_of(F.col("formatted")).alias("ts"),
                        chat.loss_texts(F.col("formatted"), F.col("loss")).alias("learn")).collect()
    assert len(found) == 120
    for r in found:
        assert r["n_turns"] == len(r["ts"]) == 2 and r["learn"] == ["fine"]
        assert [tuple(t) for t in r["ts"]] == [("user", said[r["conv_id"]]), ("assistant", "fine")]


def test_chat_parts(spark):
    schema = "conv_id bigint, turn bigint, role string, parts " + chat.PART_TYPE
    parts = [("text", "see <|image_1|> ", None, None), ("image", None, "a.png", 28 * 28 * 3 + 1), ("audio", None, "b.wav", 400),
             ("document", None, "c.pdf", 2), ("text", None, None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], schema)
    row = chat.format_conversations(turns).first()
    assert row["formatted"] == "<|im_start|>user\nsee <\\|image_1|> <|image_1|><|audio_2|><|document_3|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["turn"], a["place"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(0, 1, "a.png", 4), (0, 2, "b.wav", 10), (0, 3, "c.pdf", 3000)]
    assert row["expanded_tokens"] == 3014
    with pytest.raises(Exception, match="unknown content part"):
        chat.format_conversations(spark.createDataFrame([(1, 0, "user", [("video", None, None, None)])], schema)).collect()

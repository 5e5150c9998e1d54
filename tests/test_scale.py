"""What keeps the engine's work in proportion to its input."""

import pytest
from pyspark.sql import functions as F

from textmill import queries
from textmill.functions import embed
from textmill.functions import text as T
from textmill.functions.embed import local_embedder
from textmill.operators import answer, evaluate, index, ingest, search, verify
from textmill.sources import files

TEXTS = ["A grey ox pulls a cart. " * 3, "The ox rests at noon, the yak does not.", "Salt and salt and a yak", "?!", "A grey ox pulls a cart. " * 3]


@pytest.fixture
def opened(spark, tmp_path):
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    listed = ingest.from_table(docs)
    texts = ingest.canonical_texts(ingest.table_texts(docs), listed).select(F.col("sha256").alias("doc_id"), "text")
    counts = index.build(spark, ingest.documents_of(listed), index.chunk_rows(texts, "doc_id"), listed, str(tmp_path / "index"), local_embedder())
    assert counts == {"documents": 4, "chunks": 4, "terms": 18 + 9 + 6, "vectors": 4}
    return index.load(spark, str(tmp_path / "index"))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_searches_do_not_shuffle_the_chunks(opened, no_broadcast):
    asked = search.queries_of(opened, ["grey ox", "yak"])
    made = [search.bm25_scores(opened, asked), search.bm25(opened, asked), search.hybrid(opened, asked, local_embedder(), 2), answer.answers(opened, asked), search.vector(opened, asked, local_embedder(), 2)]
    for rows in made:
        assert "hashpartitioning(chunk_id" not in plan_of(rows) and "hashpartitioning(doc_id" not in plan_of(rows)
    assert "Exchange" not in plan_of(made[0])


def test_texts_stay_behind_when_copies_are_found(spark, no_broadcast, monkeypatch):
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate([*TEXTS, None])], "doc_id long, text string, source string")
    listed = ingest.from_table(docs)
    assert "text" not in listed.columns
    found = lambda: ingest.canonical_texts(ingest.table_texts(docs), listed)
    assert "SortMergeJoin LeftAnti" not in plan_of(found()) and sorted(r["doc_id"] for r in found().collect()) == [0, 1, 2, 3]
    monkeypatch.setattr(ingest, "BROADCAST_COPIES", 0)
    assert "ShuffledHashJoin" in plan_of(found()) and sorted(r["doc_id"] for r in found().collect()) == [0, 1, 2, 3]


def test_postings_and_places_by_hand(opened):
    flat = {(r["term"], r["tf"], r["length"]) for r in index.frequencies(opened.postings).collect()}
    assert ("salt", 2, 6) in flat and ("ox", 3, 18) in flat and ("a", 6, 18) in flat and ("a", 1, 6) in flat
    again = {tuple(r) for r in index.recounted(opened.terms).collect()}
    assert again == {(r["term"], r["chunk_id"], r["tf"]) for r in index.frequencies(opened.postings).collect()}
    cut = opened.terms.select("chunk_id", F.inline(F.array(*[F.struct((F.col("start") + k).alias("start"), F.slice("tokens", k + 1, n).alias("tokens")) for k, n in ((0, 2), (2, 100))])))
    assert {tuple(r) for r in index.places(cut).collect()} == {tuple(r) for r in index.places(opened.terms).collect()}
    assert {tuple(r) for r in index.recounted(cut).collect()} == again
    assert {(r["term"], r["position"]) for r in index.places(opened.terms).collect() if r["term"] == "salt"} == {("salt", 0), ("salt", 2)}


def test_equal_to_six_decimals_is_a_tie(spark, opened):
    made = index.Index(**{**vars(opened), "postings": spark.createDataFrame([("b", 10**7, ["ox"], [1]), ("a", 10**7 + 1, ["ox"], [1]), ("c", 5, ["ox", "yak"], [1, 2])], index.TABLES["postings"])})
    asked = search.queries_of(opened, ["ox"])
    raw = {r["chunk_id"]: r["score"] for r in search.bm25_scores(made, asked).collect()}
    assert raw["b"] > raw["a"] and raw["b"] - raw["a"] < 1e-6
    assert [r["chunk_id"] for r in search.bm25_top(made, asked, 2).orderBy("rank").collect()] == ["c", "a"]


def test_shares_of_tokens_either_way(opened, monkeypatch):
    asked = search.queries_of(opened, ["yak and salt", "ox"])
    found = lambda: sorted(map(tuple, search.overlap_scores(opened, asked).collect()))
    held = found()
    assert sorted(s for q, _, s in held if q == 0) == [0.125, 0.75]
    monkeypatch.setattr(search, "BROADCAST_TOKENS", 0)
    assert found() == held


def test_stray_terms_are_counted_exactly(spark, opened, monkeypatch):
    ids = [r["chunk_id"] for r in opened.chunks.orderBy("text").collect() if r["text"] != "?!"]
    none = "0" * 64
    own = {r["chunk_id"]: r["tokens"] for r in opened.terms.collect()}
    more = [(ids[0], 10**9, ["zzz"]), (ids[1], 2, own[ids[1]][2:4]), (none, 0, ["x", "y"]), (ids[2], 1, ["no", own[ids[2]][2]])]
    changed = opened.terms.filter(F.col("chunk_id") != ids[2]).unionByName(spark.createDataFrame(more, index.TABLES["terms"]))
    tampered = index.Index(**{**vars(opened), "terms": changed})
    given, listed = {tuple(r) for r in index.term_table(opened.chunks).collect()}, [tuple(r) for r in index.places(changed).collect()]
    wanted = {}
    for row in [r for r in listed if r not in given] + [r for r in given if r not in set(listed)]:
        wanted[row[1]] = wanted.get(row[1], 0) + 1
    found = lambda: {r["chunk_id"]: r["n"] for r in verify.stray_terms(tampered).collect()}
    assert found() == wanted == {ids[0]: 1, none: 2, ids[2]: len(own[ids[2]])}
    monkeypatch.setattr(verify, "BROADCAST_CHUNKS", 0)
    assert found() == wanted and verify.stray_terms(opened).count() == 0


def test_passages_are_found_either_way(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "x one two three four five six y"), ("b", "One two three four five six"), ("c", "tone two three four five sixty"), ("d", "two three four five")], "rel_path string, text string")
    passages = spark.createDataFrame([(1, "one two three four five six"), (2, "One two three four five six"), (3, "nine two three four five ten")], "query_id long, passage string")
    found = lambda: {tuple(r) for r in evaluate.holding(docs, passages).collect()}
    by_pass = found()
    assert by_pass == {(1, "a"), (1, "c"), (2, "b")}
    monkeypatch.setattr(evaluate, "BROADCAST_PASSAGES", 0)
    assert found() == by_pass


def test_folders_stand_for_their_files(spark, tmp_path):
    root = tmp_path / "corpus"
    for name in ("many/a.txt", "many/deep/b [1].txt", "some/c.txt", "some/_d.txt", "mixed/e.txt", "top.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / "mixed/link.txt").symlink_to(tmp_path / "outside.txt")
    (root / "mixed/near.txt").symlink_to(root / "top.txt")
    paths = files.walk(root)[0]
    assert files.covering(root, paths) == ["many/", "mixed/e.txt", "mixed/near.txt", "some/_d.txt", "some/c.txt", "top.txt"]
    assert files.covering(root, [p for p in paths if p != "many/deep/b [1].txt"])[0] == "many/a.txt"
    read = files.read_binary(spark, root, paths)
    assert sorted(r["rel_path"] for r in read.collect()) == [p for p in paths if p != "some/_d.txt"] and not any("link" in p for p in read.inputFiles())


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(400):
        (tmp_path / f"{k}.txt").write_text(str(k))
    read = files.read_binary(spark, tmp_path, files.listed(tmp_path))
    assert files.covering(tmp_path, files.listed(tmp_path)) == [""] and read.count() == 400
    assert read.rdd.getNumPartitions() <= 8


def test_files_are_hashed_once(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.txt").write_text(f"text {k // 2}")
    found = ingest.ingest(spark, tmp_path)
    assert found["files"].count() == 6
    for k in range(6):
        (tmp_path / f"{k}.txt").unlink()
    assert found["files"].filter("status = 'duplicate'").count() == 3 and found["quarantine"].count() == 0


def test_features_are_counted_without_their_strings(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "Aaa aaaa, aaa b2 \u0130stanbul"), (2, "?!"), (3, None), (4, "to be or not to be")], "doc_id long, text string")
    f = T.features(F.coalesce("text", F.lit("")))
    wanted = {tuple(r) for r in rows.select("doc_id", F.size(f), F.size(F.array_distinct(f))).collect()}
    assert {tuple(r) for r in embed.feature_counts(rows).collect()} == wanted
    monkeypatch.setattr(embed, "MEMO_TOKENS", 1)
    assert {tuple(r) for r in embed.feature_counts(rows).collect()} == wanted
    assert "flatten" not in plan_of(queries.ngram_features(spark, "/root/testdata/sf0.001"))


def test_equal_chunks_have_equal_scores(spark, opened):
    words = "salt yak ox cart grey noon".split()
    texts = spark.createDataFrame([(f"d{k}", 0, " ".join(words[k:] + words[:k])) for k in range(6)], "doc_id string, chunk_index long, text string")
    postings = index.posting_table(index.with_ids(texts).repartition(3))
    asked = search.queries_of(opened, [" ".join(words)])
    assert len({r["score"] for r in search.bm25_scores(index.Index(**{**vars(opened), "postings": postings}), asked).collect()}) == 1

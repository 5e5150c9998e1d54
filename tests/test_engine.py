import json
import urllib.parse
import zlib

import pytest
from pyspark.sql import functions as F

from textmill import api, cli, demo, mcp
from textmill.functions.embed import local_embedder
from textmill.functions.hashing import sha256
from textmill.operators import answer, evaluate, index, ingest, lookup, search, verify
from textmill.sources import files, pdf

#: Tokens of the three different texts of the corpus.
TERMS = 13 + 13 + 4


@pytest.fixture
def built(spark, corpus, tmp_path):
    found = ingest.ingest(spark, corpus)
    documents = ingest.documents_of(found["files"])
    texts, errors = ingest.texts_of(spark, corpus, documents)
    counts = index.build(spark, documents, ingest.chunks_of(texts), found["files"], str(tmp_path / "index"), local_embedder())
    assert errors.count() == 0
    return index.load(spark, str(tmp_path / "index")), counts, found


def disk_of(spark, corpus):
    return files.read_binary(spark, corpus, files.listed(corpus)).select("rel_path", sha256(F.col("content")).alias("actual"))


def none_exempt(spark):
    return files.read_exemptions(spark, None)


def test_ingest(spark, corpus, tmp_path):
    (corpus / "bad.txt").write_bytes(b"latin \xe9t\xe9")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside/secret.txt").write_text("secret")
    (corpus / "link.txt").symlink_to(tmp_path / "outside/secret.txt")
    (corpus / "away").symlink_to(tmp_path / "outside")
    (corpus / "inner").symlink_to(corpus / "animals")
    (corpus / "animals/loop").symlink_to(corpus)
    odd = "spare/a [b]{c}*,+%20#é?.txt"
    (corpus / odd).write_text("an odd name")
    found = ingest.ingest(spark, corpus, tmp_path / "quarantine")
    manifest = ingest.manifest_dict(found, corpus)
    assert manifest["summary"] == {"files": 5, "unique": 4, "duplicates": 1, "quarantined": 3, "skipped": 1, "symlink_dirs_skipped": 2}
    assert {f["rel_path"]: f["duplicate_of"] for f in manifest["files"]} == {"animals/ox.md": None, "animals/yak.txt": None, "ledger.csv": None, odd: None, "spare/ox again.md": "animals/ox.md"}
    assert {q["rel_path"]: q["reason"] for q in manifest["quarantine"]} == {"away": "symlink directory escapes corpus root", "bad.txt": "not valid UTF-8 text", "link.txt": "symlink escapes corpus root"}
    assert manifest["duplicates"][0]["duplicates"] == ["spare/ox again.md"]
    kept = sorted(p.name for p in (tmp_path / "quarantine").iterdir())
    assert kept == ["bad.txt", files.QUARANTINE_LOG] and (tmp_path / "quarantine/bad.txt").read_bytes() == b"latin \xe9t\xe9"
    assert [line.split("\t")[0] for line in (tmp_path / "quarantine" / files.QUARANTINE_LOG).read_text().splitlines()] == ["away", "bad.txt", "link.txt"]
    (tmp_path / "quarantine/mine.txt").write_text("not from here")
    (corpus / "bad.txt").unlink()
    ingest.ingest(spark, corpus, tmp_path / "quarantine")
    assert sorted(p.name for p in (tmp_path / "quarantine").iterdir()) == ["mine.txt", files.QUARANTINE_LOG]
    files.write_manifest(manifest, tmp_path / "m.json")
    assert files.manifest_files(files.read_manifest(spark, str(tmp_path / "m.json"))).count() == 5
    assert ingest.write_tables(found, str(tmp_path / "tables"))["unique"] == 4
    with pytest.raises(files.UnsafePathError):
        ingest.ingest(spark, corpus, corpus / "q")


def test_refused_paths_are_never_opened(spark, corpus, tmp_path):
    (tmp_path / "outside.txt").write_text("secret")
    (corpus / "link.txt").symlink_to(tmp_path / "outside.txt")
    (corpus / "animals/loop").symlink_to(corpus)
    read = files.read_binary(spark, corpus, files.listed(corpus))
    assert len(read.inputFiles()) == 5 and not any("link" in p or "loop" in p for p in read.inputFiles())
    listed = files.listed(corpus)
    (corpus / "ledger.csv").unlink()
    assert files.read_binary(spark, corpus, listed[:1]).count() == 1 and files.read_binary(spark, corpus, []).count() == 0


def test_parse_counters(spark, corpus, tmp_path):
    (corpus / "blank.txt").write_text(" \n\n")
    (corpus / "plan.pdf").write_bytes(demo.pdf(("one page", "two pages")))
    listed = ingest.documents_of(ingest.ingest(spark, corpus)["files"])
    documents = spark.createDataFrame(listed.collect(), listed.schema)
    (corpus / "ledger.csv").unlink()
    for pdf in (True, False):
        texts, errors = ingest.texts_of(spark, corpus, documents, pdf)
        counted = ingest.parse_counters(documents, texts, ingest.chunks_of(texts), errors).first().asDict()
        assert counted == {"documents": 5, "chunks": 2 + pdf, "pdf_ok": int(pdf), "pdf_skipped": int(not pdf), "empty": 1, "errors": 1}


def test_pdf_texts():
    assert pdf.text(demo.pdf(("one (1)".replace("(", "\\(").replace(")", "\\051"), "two"))) == "one (1)\n\ntwo"
    cmap = b"2 beginbfchar\n<0001> <0048>\n<0002> <00E9>\nendbfchar 1 beginbfrange <0003> <0005> <0061> endbfrange"
    shown = b"BT /F1 9 Tf [<00010002> -500 <0003>] TJ 0 -12 Td <00040005> Tj ET"
    packed = b"<< /Type /Pages /Kids [4 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >> << /Type /Page /Parent 3 0 R /Contents [7 0 R] >> << /Type /Font /Subtype /Type0 /ToUnicode 8 0 R >>"
    second, third = packed.index(b"<< /Type /Page "), packed.index(b"<< /Type /Font")
    head = f"3 0 4 {second} 5 {third} ".encode()
    stream = lambda body, more=b"": b"<< " + more + b"/Filter /FlateDecode /Length %d >>\nstream\n" % len(zlib.compress(body)) + zlib.compress(body) + b"\nendstream"
    objects = {1: b"<< /Type /Catalog /Pages 3 0 R >>", 2: stream(head + packed, b"/Type /ObjStm /N 3 /First %d " % len(head)), 7: stream(shown), 8: stream(cmap)}
    whole = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % k + body + b"\nendobj\n" for k, body in objects.items())
    assert pdf.text(whole) == "H\u00e9 a\nbc"
    for bad in (b"", b"no pdf", b"%PDF-1.4", demo.pdf(("x",)).replace(b"/Kids [4 0 R]", b"/Kids [2 0 R]"), whole + b"/Encrypt", whole.replace(b"FlateDecode", b"DCTDecode")):
        with pytest.raises((pdf.PdfError, ValueError, zlib.error)):
            pdf.text(bad)


def test_build_is_repeatable(spark, corpus, built, tmp_path):
    opened, counts, found = built
    assert counts == {"documents": 3, "chunks": 3, "terms": TERMS, "vectors": 3}
    documents = ingest.documents_of(found["files"])
    texts, _ = ingest.texts_of(spark, corpus, documents)
    index.build(spark, documents.orderBy(F.desc("doc_id")), ingest.chunks_of(texts).repartition(3), found["files"], str(tmp_path / "again"), local_embedder())
    again = index.load(spark, str(tmp_path / "again"))
    assert lookup.stats(again) == lookup.stats(opened) and len(lookup.stats(opened)["run_id"]) == 64
    assert opened.read_meta()["embed_dim"] == "384" and opened.vector_dim() == 384


def test_failed_build_keeps_the_old_index(spark, built, tmp_path):
    opened, _, found = built

    class Broken:
        name, dim = "broken", 3

        def embed(self, texts):
            raise RuntimeError("no")

    with pytest.raises(Exception):
        index.build(spark, opened.documents, opened.chunks, found["files"], str(tmp_path / "index"), Broken())
    assert index.load(spark, str(tmp_path / "index")).chunks.count() == 3


def test_searches(built, monkeypatch):
    opened, _, _ = built
    asked = search.queries_of(opened, ["yak", "heavy cart", "", "yak salt"])
    exact = search.exact_term(opened, asked).collect()
    assert [(r["query_id"], r["positions"]) for r in exact] == [(0, [1])]
    ranked = search.bm25(opened, asked).collect()
    assert {(r["query_id"], r["rel_path"]) for r in ranked} == {(0, "animals/yak.txt"), (1, "animals/ox.md"), (3, "animals/yak.txt"), (3, "ledger.csv")}
    assert all(r["score"] > 0 for r in ranked)
    monkeypatch.setattr(search, "BROADCAST_TOKENS", 0)
    assert sorted(search.bm25(opened, asked).collect()) == sorted(ranked)
    near = search.vector(opened, asked, local_embedder(), 1).filter("query_id = 0").first()
    assert near["rel_path"] == "animals/yak.txt" and -1 <= near["score"] <= 1.000001 and near["positions"] == []
    best = search.hybrid(opened, search.queries_of(opened, ["oxen rests", "qqqq"]), local_embedder(), 2).filter("rank = 1").orderBy("query_id").collect()
    assert [round(r["score"], 6) for r in best] == [1.0, 1.0] and best[0]["rel_path"] == "animals/ox.md"
    with pytest.raises(ValueError):
        search.run(opened, asked, "nope")


def test_fusion_corner_cases(spark):
    side = lambda rows: spark.createDataFrame(rows, "query_id long, chunk_id string, score double")
    fused = {r["chunk_id"]: r["score"] for r in search.fuse(side([]), side([(0, "a", 0.9), (0, "b", 0.1)]), 5).collect()}
    assert fused == {"a": 1.0, "b": 0.5}  # a side without rows counts 1 for everyone
    assert search.fuse(side([(0, "a", 3.0)]), side([(0, "a", 0.2)]), 5).first()["score"] == 1.0
    fused = {r["chunk_id"]: r["score"] for r in search.fuse(side([(0, "a", 2.0), (0, "b", 1.0)]), side([(0, "b", 0.5), (0, "c", 0.1)]), 5).collect()}
    assert fused == {"a": 0.5, "b": 0.5, "c": 0.0}  # a lacking side is as good as that side's last


def test_lookups(spark, built):
    opened, _, _ = built
    listed = lookup.list_documents(opened).collect()
    assert [(r["rel_path"], r["chunks"]) for r in listed] == [("animals/ox.md", 1), ("animals/yak.txt", 1), ("ledger.csv", 1)]
    assert lookup.get_document(opened, listed[0]["doc_id"])["chunks"][0]["text"].startswith("# Oxen")
    assert lookup.get_document(opened, "missing") is None
    wanted = spark.createDataFrame([(listed[0]["doc_id"], 0)], "doc_id string, chunk_index long")
    assert lookup.chunk_context(opened, wanted).count() == 1
    bare = index.Index(**{**vars(opened), "chunks": opened.chunks.limit(0)})
    assert lookup.get_document(bare, listed[0]["doc_id"])["chunks"] == []


def test_answers(built):
    opened, _, _ = built
    found = {r["query"]: r for r in answer.answers(opened, search.queries_of(opened, ["grey cart", "unknown question", ""])).collect()}
    good = found["grey cart"]
    assert not good["refused"] and good["citations"][0]["text"] == "The grey ox pulls a heavy cart uphill." and good["citations"][0]["marker"] in good["answer"]
    assert found["unknown question"]["refused"] and found["unknown question"]["answer"].startswith("Refusal:") and found[""]["refused"]


def test_metrics_by_hand(spark):
    queries = spark.createDataFrame([(0, "q0", "a"), (1, "q1", "b"), (2, "q2", "z")], "query_id long, query string, rel_doc string")
    hits = [(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 1, "x"), (1, 2, "b"), (1, 3, "y"), (2, 1, "a"), (2, 2, "b"), (2, 3, "c")]
    ranks = evaluate.relevant_ranks(queries, spark.createDataFrame(hits, "query_id long, rank int, rel_path string"))
    metrics = evaluate.retrieval_metrics(ranks, 3)
    assert metrics.first().asDict() == {"n_queries": 3, "recall_at_k": 0.666667, "precision_at_k": 0.222222, "mrr": 0.5}
    base = lambda mrr: spark.createDataFrame([(0.6, 0.2, mrr)], "recall_at_k double, precision_at_k double, mrr double")
    assert all(r["passed"] for r in evaluate.against_baseline(metrics, base(0.5)).collect())
    assert not all(r["passed"] for r in evaluate.against_baseline(metrics, base(0.6)).collect())
    with pytest.raises(ValueError):
        evaluate.retrieval_metrics(ranks, 0)


def test_evaluations_end_to_end(spark, built, tmp_path):
    opened, _, _ = built
    items = [{"query": "grey ox", "rel_doc": "animals/ox.md"}, {"query": "walks on ice", "rel_doc": "animals/yak.txt"}]
    (tmp_path / "bare.json").write_text(json.dumps(items))
    (tmp_path / "q.json").write_text(json.dumps({"queries": items}))
    queries = files.read_queries(spark, str(tmp_path / "q.json"))
    assert queries.collect() == files.read_queries(spark, str(tmp_path / "bare.json")).collect()
    assert evaluate.evaluate(opened, queries, local_embedder())[0].first()["mrr"] == 1.0
    found = evaluate.evaluate_answers(opened, queries)[0].first()
    assert (found["refusals"], found["citation_precision"], found["citation_recall"]) == (0, 1.0, 1.0)


def test_verify(spark, corpus, built, tmp_path):
    opened, _, found = built
    listed = spark.createDataFrame(found["files"].collect(), files.FILES)
    ok, _, summary = verify.verify(opened, listed, disk_of(spark, corpus), none_exempt(spark), deep=True)
    assert ok and summary == {"documents": 3, "chunks": 3, "terms": TERMS, "exempted": 0, "failures": 0}
    messages = lambda o, d, e: [r["message"] for r in verify.verify(o, listed, d, e)[1].collect()]
    stray = spark.createDataFrame([("c" * 64, "d" * 64, 0, "stray")], index.TABLES["chunks"])
    bad = index.Index(**{**vars(opened), "chunks": opened.chunks.unionByName(stray)})
    assert messages(bad, disk_of(spark, corpus), none_exempt(spark)) == ["1 chunk(s) reference a missing document", "runs.chunk_count 3 != live count 4"]
    zero = opened.documents.withColumn("sha256", F.when(F.col("rel_path") == "animals/ox.md", F.repeat(F.lit("0"), 64)).otherwise(F.col("sha256")))
    said = messages(index.Index(**{**vars(opened), "documents": zero}), disk_of(spark, corpus), none_exempt(spark))
    assert len(said) == 2 and "!= stored sha256" in said[0] and "hash mismatch" in said[1]
    changed = opened.chunks.withColumn("text", F.concat("text", F.lit(" !")))
    assert verify.deep_failures(index.Index(**{**vars(opened), "chunks": changed})).filter("check_no = 11").count() == 3
    no_run = index.Index(**{**vars(opened), "runs": opened.runs.limit(0)})
    assert messages(no_run, disk_of(spark, corpus), none_exempt(spark)) == ["expected exactly 1 run row, found 0"]
    (corpus / "animals/yak.txt").unlink()
    assert messages(opened, disk_of(spark, corpus), none_exempt(spark)) == ["document animals/yak.txt: source file missing from disk"]
    (tmp_path / "e.json").write_text('{"rel_paths": ["animals/yak.txt"]}')
    ok, _, summary = verify.verify(opened, listed, disk_of(spark, corpus), files.read_exemptions(spark, str(tmp_path / "e.json")))
    assert ok and summary["exempted"] == 1


def test_chunk_files(spark, built, tmp_path):
    opened, _, _ = built
    rows = opened.chunks.join(opened.documents.select("doc_id", "rel_path"), "doc_id")
    files.write_chunks(rows, str(tmp_path / "chunks"))
    assert files.read_chunks(spark, str(tmp_path / "chunks")).count() == 3


def test_http_answers(built):
    opened, _, _ = built
    assert api.respond(opened, "/health") == (200, {"status": "ok", "documents": 3})
    assert api.respond(opened, "/search?q=yak")[1]["hits"][0]["positions"] == [1]
    assert api.respond(opened, "/search?q=heavy+cart&mode=hybrid&limit=1")[1]["hits"][0]["rel_path"] == "animals/ox.md"
    assert [api.respond(opened, p)[0] for p in ("/search", "/search?q=a&limit=101", "/search?q=a&mode=x", "/documents?limit=0", "/documents/none", "/else")] == [422, 422, 422, 422, 404, 404]
    status, documents = api.respond(opened, "/documents")
    assert status == 200 and api.respond(opened, "/documents/" + urllib.parse.quote(documents[0]["doc_id"]))[1]["rel_path"] == "animals/ox.md"
    assert api.respond(opened, "/stats")[1]["doc_count"] == 3


def test_commands_hand_their_files_on(spark, corpus, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    assert cli.main(["ingest", str(corpus), "--out", at("m.json")]) == 0
    assert cli.main(["parse", "--manifest", at("m.json"), "--out", at("chunks")]) == 0
    (corpus / "animals/yak.txt").unlink()  # the index is made of what parse has written
    assert cli.main(["index", "--manifest", at("m.json"), "--chunks", at("chunks"), "--out", at("index")]) == 0
    assert index.load(spark, at("index")).chunks.count() == 3
    assert cli.main(["verify", str(corpus), "--manifest", at("m.json"), "--index", at("index")]) == 1
    assert "animals/yak.txt: source file missing from disk" in capsys.readouterr().out


def test_the_demo_is_the_same_each_time(tmp_path):
    for name in ("one", "two"):
        demo.write(tmp_path / name, tmp_path / f"{name}.json")
    made = [sorted((p.relative_to(tmp_path / n).as_posix(), p.read_bytes()) for p in (tmp_path / n).rglob("*") if p.is_file()) for n in ("one", "two")]
    assert made[0] == made[1] and len(made[0]) == 17 and len({c for _, c in made[0]}) == 16
    asked = json.loads((tmp_path / "one.json").read_text())["queries"]
    assert len(asked) == 14 and {q["rel_doc"] for q in asked} <= {p for p, _ in made[0]}


def test_tool_server():
    seen = []

    def run(argv):
        seen.append(argv)
        print("done")
        return 1

    ask = lambda method, **params: mcp.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}, run)
    assert ask("initialize")["result"]["serverInfo"]["name"] == "textmill" and ask("ping")["result"] == {}
    assert len(ask("tools/list")["result"]["tools"]) == 7
    found = ask("tools/call", name="search", arguments={"query": "x", "limit": 3})["result"]
    assert found["isError"] and found["content"][0]["text"] == "done\n" and seen == [["query", "search", "x", "--limit", "3"]]
    for check in (True, False):
        ask("tools/call", name="eval", arguments={"check": check, "baseline": "b.json"})
    assert seen[1:] == [["eval", "--check", "--baseline", "b.json"], ["eval", "--baseline", "b.json"]]
    assert ask("tools/call", name="search", arguments={})["result"]["isError"]
    assert "error" in ask("tools/call", name="nope") and "error" in ask("nope") and ask("prompts/list")["result"] == {"prompts": []}
    assert mcp.handle({"method": "notifications/initialized"}) is None


def test_streaming(spark, tmp_path):
    from textmill.streaming import incremental

    (tmp_path / "in").mkdir()
    rows = [{"rel_path": f"{i}.txt", "text": t, "arrived": "2026-01-01T00:00:00Z"} for i, t in enumerate(["one two", "one two", "three"])]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    incremental.append_index(incremental.read_arrivals(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/documents")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/terms")).count() == 3


def test_nearest_by_matrix_and_by_blocks(spark, monkeypatch):
    rows = [(f"c{k:03d}", [float((k * j) % 7 - 3) for j in range(1, 9)]) for k in range(60)] + [("zero", [0.0] * 8), ("short", [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    made = index.Index(**{f: None for f in index.Index.__dataclass_fields__} | {"vectors": index.with_norm(vectors)})
    asked = spark.createDataFrame([(1, [1.0, -2.0, 3.0, 0.0, 1.0, 1.0, -1.0, 2.0]), (2, [0.0] * 8), (3, [2.0, 1.0])], "query_id long, embedding array<float>")
    found = lambda: {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["score"], 9)) for r in search.nearest(made, asked, 5).collect()}
    by_matrix = found()
    length = lambda v: sum(x * x for x in v) ** 0.5
    for q in asked.collect():
        scored = sorted((-round(sum(x * y for x, y in zip(v, q["embedding"])) / (length(v) * length(q["embedding"]) or 1), 12), c) for c, v in rows if len(v) == len(q["embedding"]))[:5]
        assert [by_matrix[q["query_id"], k + 1] for k in range(len(scored))] == [(c, round(-s, 9) + 0.0) for s, c in scored]
    monkeypatch.setattr(search, "SCORES", 40)
    assert found() == by_matrix
    monkeypatch.setattr(search, "BROADCAST_VECTORS", 2)
    monkeypatch.setattr(search, "SHARD_VECTORS", 20)
    assert found() == by_matrix

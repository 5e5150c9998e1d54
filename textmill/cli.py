"""Command line: build, query and audit an index.

    python -m textmill demo CORPUS --queries queries.json
    python -m textmill ingest CORPUS --out manifest.json --quarantine-dir DIR
    python -m textmill parse --manifest manifest.json --out chunks
    python -m textmill index --manifest manifest.json --chunks chunks --out index
    python -m textmill query search "some words" --index index --mode hybrid
    python -m textmill query doc|list|context|stats ...
    python -m textmill verify CORPUS --index index
    python -m textmill eval --index index --queries queries.json --check
    python -m textmill answer "some question" --index index
    python -m textmill api --index index --port 8000
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import demo
from .functions.embed import Embedder, EmbeddingError, embedder_of, http_embedder, local_embedder
from .functions.hashing import sha256
from .operators import answer, evaluate, index, ingest, lookup, search, verify
from .plans.session import session
from .sources import files

VERSION = "0.1.0"
ENV = "TEXTMILL_EMBEDDING_"


def _spark() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        spark = session(os.environ.get("TEXTMILL_MASTER", "local[*]"), int(os.environ.get("TEXTMILL_PARTITIONS", "8")))
        spark.sparkContext.setLogLevel("ERROR")
    return spark


def resolve_embedder(name: str, base_url: str | None, api_key: str | None, model: str | None) -> Embedder:
    if name == "local":
        return local_embedder()
    return http_embedder(*(given or os.environ.get(ENV + key, "") for given, key in ((base_url, "BASE_URL"), (model, "MODEL"), (api_key, "API_KEY"))))


def _open(spark: SparkSession, path: str) -> tuple[index.Index, Embedder]:
    found = index.load(spark, path)
    meta = found.read_meta()
    return found, embedder_of(meta, os.environ.get(ENV + "API_KEY")) if "embedder" in meta else local_embedder()


def _index_is_there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/documents")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def do_demo(a: argparse.Namespace) -> int:
    print(json.dumps(demo.write(a.corpus, a.queries, a.seed)))
    return 0


def do_ingest(a: argparse.Namespace) -> int:
    found = ingest.ingest(_spark(), a.corpus, a.quarantine_dir)
    if a.tables:
        print(json.dumps(ingest.write_tables(found, a.tables)))
        return 0
    manifest = ingest.manifest_dict(found, a.corpus)
    files.write_manifest(manifest, a.out)
    print(json.dumps(manifest["summary"]))
    return 0


def do_parse(a: argparse.Namespace) -> int:
    spark = _spark()
    manifest = files.read_manifest(spark, a.manifest)
    documents = ingest.documents_of(files.manifest_files(manifest))
    texts, errors = ingest.texts_of(spark, a.corpus or manifest.first()["corpus_root"], documents, not a.no_pdf)
    files.write_chunks(ingest.chunks_of(texts), a.out)
    counters = ingest.parse_counters(documents, texts, files.read_chunks(spark, a.out), errors).first().asDict()
    print(json.dumps(counters))
    for row in errors.filter(F.col("error") != ingest.PDF_SKIPPED).orderBy("rel_path").toLocalIterator():
        print(f"{row['rel_path']}: {row['error']}", file=sys.stderr)
    return 1 if a.strict and counters["errors"] else 0


def do_index(a: argparse.Namespace) -> int:
    spark = _spark()
    if a.corpus:
        listed = ingest.ingest(spark, a.corpus)["files"]
        chunks = ingest.chunks_of(ingest.texts_of(spark, a.corpus, ingest.documents_of(listed))[0])
    else:
        listed, chunks = files.manifest_files(files.read_manifest(spark, a.manifest)), files.read_chunks(spark, a.chunks)
    embedder = None if a.embedder == "none" else resolve_embedder(a.embedder, a.embedding_base_url, a.embedding_api_key, a.embedding_model)
    print(json.dumps(index.build(spark, ingest.documents_of(listed), chunks, listed, a.out, embedder)))
    return 0


def do_search(a: argparse.Namespace) -> int:
    opened, embedder = _open(_spark(), a.index)
    hits = search.run(opened, search.queries_of(opened, [a.term]), a.mode, embedder, a.limit).orderBy("rank").collect()
    for h in hits:
        score = "" if a.mode == "term" else f" {h['score']:.4f}"
        print(f"{h['doc_id'][:12]}:{h['chunk_index']}{score} {h['rel_path']} {h['snippet']!r}")
    print(f"{len(hits)} hits")
    return 0


def do_doc(a: argparse.Namespace) -> int:
    found = lookup.get_document(_open(_spark(), a.index)[0], a.doc_id)
    print(json.dumps(found, indent=2) if found else f"no document {a.doc_id}")
    return 0 if found else 1


def do_list(a: argparse.Namespace) -> int:
    for d in lookup.list_documents(_open(_spark(), a.index)[0], a.limit).collect():
        print(f"{d['doc_id'][:12]} {d['rel_path']} ({d['kind']}, {d['size']} bytes, {d['chunks']} chunks)")
    return 0


def do_context(a: argparse.Namespace) -> int:
    spark = _spark()
    wanted = spark.createDataFrame([(a.doc_id, a.chunk_index)], "doc_id string, chunk_index long")
    rows = lookup.chunk_context(_open(spark, a.index)[0], wanted, a.window).orderBy("chunk_index").collect()
    for r in rows:
        print(f"[{r['chunk_index']}] {r['text']}")
    return 0 if rows else 1


def do_stats(a: argparse.Namespace) -> int:
    print(json.dumps(lookup.stats(_open(_spark(), a.index)[0]), indent=2))
    return 0


def do_verify(a: argparse.Namespace) -> int:
    spark = _spark()
    if not os.path.isdir(a.corpus) or not _index_is_there(spark, a.index) or (a.manifest and not os.path.exists(a.manifest)):
        print("the corpus, the index or the manifest is missing", file=sys.stderr)
        return 2
    opened = index.load(spark, a.index)
    listed = files.manifest_files(files.read_manifest(spark, a.manifest)) if a.manifest else ingest.ingest(spark, a.corpus)["files"]
    disk = files.read_binary(spark, a.corpus, files.listed(a.corpus)).select("rel_path", sha256(F.col("content")).alias("actual"))
    ok, found, summary = verify.verify(opened, listed, disk, files.read_exemptions(spark, a.exemptions), a.deep)
    for row in found.toLocalIterator():
        print(row["message"])
    print(json.dumps(summary))
    return 0 if ok else 1


def do_eval(a: argparse.Namespace) -> int:
    spark = _spark()
    opened, embedder = _open(spark, a.index)
    metrics, ranks = evaluate.evaluate(opened, files.read_queries(spark, a.queries), embedder, a.k, a.mode)
    print(evaluate.report(metrics.first().asDict(), [r.asDict() for r in ranks.orderBy("query_id").collect()], a.mode, a.k))
    if not a.check:
        return 0
    base = files.read_baseline(a.baseline)
    gate = evaluate.against_baseline(metrics, spark.createDataFrame([tuple(base[k] for k in evaluate.KEYS)], ", ".join(f"{k} double" for k in evaluate.KEYS))).collect()
    for row in gate:
        print(f"{row['metric']}: {row['current']} against {row['baseline']}: {'passed' if row['passed'] else 'REGRESSED'}")
    return 0 if all(r["passed"] for r in gate) else 1


def do_answer(a: argparse.Namespace) -> int:
    opened, embedder = _open(_spark(), a.index)
    found = answer.answers(opened, search.queries_of(opened, [a.query]), embedder, a.mode, a.k).first().asDict()
    print(answer.render(found))
    return 1 if found["refused"] else 0


def do_api(a: argparse.Namespace) -> int:
    from .api import serve

    serve(_spark(), a.index, a.host, a.port)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textmill", description=__doc__.splitlines()[0])
    top.add_argument("--version", action="version", version=VERSION)
    sub = top.add_subparsers(required=True)

    def command(under, name: str, run, *arguments: tuple) -> None:
        made = under.add_parser(name)
        made.set_defaults(run=run)
        for *names, options in arguments:
            made.add_argument(*names, **options)

    at = ("--index", {"default": "index"})
    k = ("--k", {"type": int, "default": 5})
    mode = lambda default: ("--mode", {"choices": search.MODES, "default": default})
    limit = lambda default: ("--limit", {"type": int, "default": default})
    command(sub, "demo", do_demo, ("corpus", {}), ("--queries", {"default": "queries.json"}), ("--seed", {"type": int, "default": demo.SEED}))
    command(sub, "ingest", do_ingest, ("corpus", {}), ("--out", {"default": "manifest.json"}), ("--tables", {"default": None}), ("--quarantine-dir", {"default": None}))
    command(sub, "parse", do_parse, ("--manifest", {"default": "manifest.json"}), ("--out", {"default": "chunks"}), ("--corpus", {"default": None}), ("--no-pdf", {"action": "store_true"}), ("--strict", {"action": "store_true"}))
    command(sub, "index", do_index, ("--manifest", {"default": "manifest.json"}), ("--chunks", {"default": "chunks"}), ("--corpus", {"default": None}), ("--out", {"default": "index"}), ("--embedder", {"choices": ("local", "http", "none"), "default": "local"}), ("--embedding-base-url", {}), ("--embedding-api-key", {}), ("--embedding-model", {}))
    command(sub, "verify", do_verify, ("corpus", {}), at, ("--manifest", {"default": None}), ("--exemptions", {"default": None}), ("--deep", {"action": "store_true"}))
    command(sub, "eval", do_eval, at, ("--queries", {"default": "queries.json"}), k, mode("hybrid"), ("--check", {"action": "store_true"}), ("--baseline", {"default": "baseline.json"}))
    command(sub, "answer", do_answer, ("query", {}), at, k, mode("hybrid"))
    command(sub, "api", do_api, at, ("--host", {"default": "127.0.0.1"}), ("--port", {"type": int, "default": 8000}))
    q = sub.add_parser("query").add_subparsers(required=True)
    command(q, "search", do_search, ("term", {}), at, limit(20), mode("term"))
    command(q, "doc", do_doc, ("doc_id", {}), at)
    command(q, "list", do_list, at, limit(100))
    command(q, "context", do_context, ("doc_id", {}), ("chunk_index", {"type": int}), at, ("--window", {"type": int, "default": 1}))
    command(q, "stats", do_stats, at)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except (EmbeddingError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2

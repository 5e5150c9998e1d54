"""Corpora on disk and the files that stages leave for each other."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pdf

FILES = "rel_path string, sha256 string, size long, kind string, status string, duplicate_of string"
QUARANTINE = "rel_path string, reason string, sha256 string"
SKIPPED = "rel_path string, kind string, reason string"
DUPLICATES = "sha256 string, canonical string, duplicates array<string>"
CHUNKS = "chunk_index long, doc_id string, rel_path string, text string"
MANIFEST = (
    f"schema_version int, corpus_root string, files array<struct<{FILES.replace(' ', ':').replace(',:', ',')}>>, "
    f"quarantine array<struct<{QUARANTINE.replace(' ', ':').replace(',:', ',')}>>, skipped array<struct<{SKIPPED.replace(' ', ':').replace(',:', ',')}>>, "
    "duplicates array<struct<sha256:string,canonical:string,duplicates:array<string>>>, "
    "summary struct<files:long,unique:long,duplicates:long,quarantined:long,skipped:long,symlink_dirs_skipped:long>"
)


class UnsafePathError(ValueError):
    """A path that leaves the folder it has to stay in."""


def resolve_within(root: str | Path, path: str | Path) -> Path:
    """The real path of ``path`` if it lies under ``root``."""
    base = Path(root).resolve()
    real = (base / path).resolve()
    if real != base and base not in real.parents:
        raise UnsafePathError(f"{path} leaves {root}")
    return real


def is_within(root: str | Path, path: str | Path) -> bool:
    try:
        resolve_within(root, path)
    except UnsafePathError:
        return False
    return True


def walk(root: str | Path) -> tuple[list[str], list[tuple[str, str]], int]:
    """Paths to read, paths to quarantine with a reason, and how many linked
    folders inside the root were passed over. Only a local folder has links;
    this looks at names, never at contents."""
    base = Path(root).resolve()
    paths, refused, passed = [], [], 0
    for folder, folders, names in os.walk(base, followlinks=False):
        here, plain = Path(folder), []
        for name in sorted(folders):
            if not (here / name).is_symlink():
                plain.append(name)
            elif is_within(base, here / name):
                passed += 1
            else:
                refused.append(((here / name).relative_to(base).as_posix(), "symlink directory escapes corpus root"))
        folders[:] = plain
        for name in sorted(names):
            path = here / name
            rel = path.relative_to(base)
            if ".." in rel.parts:
                refused.append((rel.as_posix(), "path traversal"))
            elif path.is_symlink() and not is_within(base, path):
                refused.append((rel.as_posix(), "symlink escapes corpus root"))
            elif not os.path.exists(path):
                refused.append((rel.as_posix(), "unreadable: FileNotFoundError"))
            elif not os.access(path, os.R_OK):
                refused.append((rel.as_posix(), "unreadable: PermissionError"))
            else:
                paths.append(rel.as_posix())
    return sorted(paths), sorted(refused), passed


def is_local(root: str | Path) -> bool:
    return "://" not in str(root)


def listed(root: str | Path) -> list[str] | None:
    """The paths under a local root that may be read; None for a root that only
    Spark can list, where there are no links."""
    return walk(root)[0] if is_local(root) else None


def covering(base: Path, paths: list[str]) -> list[str]:
    """The fewest folders and files under a folder that hold these paths and
    nothing else. A folder stands for its files if all of them are listed, none is
    a link and none has a name that Spark passes over."""
    wanted = set(paths)

    def cover(folder: str, rel: str) -> tuple[bool, list[str]]:
        whole, inside = True, []
        with os.scandir(folder) as entries:
            for e in entries:
                path = f"{rel}{e.name}"
                plain = not e.is_symlink() and e.name[0] not in "._"
                if e.is_dir(follow_symlinks=False):
                    all_of_it, parts = cover(e.path, f"{path}/")
                    whole = whole and plain and all_of_it
                    inside += parts
                elif path in wanted:
                    whole = whole and plain
                    inside.append(path)
                else:
                    whole = False
        return whole, [rel] if whole and inside else inside

    return sorted(cover(str(base), "")[1])


#: Partitions of listed files that make a task: Spark reckons a small file as 4 MB, and gives a task some thirty.
FILE_PARTITIONS = 64


def read_binary(spark: SparkSession, root: str | Path, paths: list[str] | None = None) -> DataFrame:
    """rel_path, content and size: of the files in ``paths`` and no others, or,
    without paths, of all files under a root without links. A file that has gone
    since it was listed has no row."""
    base = f"file://{Path(root).resolve().as_posix()}" if is_local(root) else str(root).rstrip("/")
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    if paths is None:
        found = reader.option("recursiveFileLookup", "true").load(base)
    elif paths:
        at = covering(Path(root).resolve(), paths) if is_local(root) else paths
        found = reader.option("recursiveFileLookup", "true").load([re.sub(r"([\[\]{}*?,\\^])", r"\\\1", f"{base}/{p}".rstrip("/")) for p in at]) if at else None
    else:
        found = None
    if found is None:
        return spark.createDataFrame([], "rel_path string, content binary, size long")
    parts = found.rdd.getNumPartitions()
    found = found.coalesce(min(parts, max(4 * spark.sparkContext.defaultParallelism, parts // FILE_PARTITIONS)))
    root_path = re.sub("^[a-z0-9]+:/+", "/", base) if is_local(root) else base
    shown = F.regexp_replace("path", "^file:/+", "/")  # as the file system names it, nothing escaped
    return found.select(F.substring(shown, F.lit(len(root_path) + 2), F.length(shown)).alias("rel_path"), "content", F.col("length").alias("size"))


def pdf_reader() -> Callable[[bytes], str]:
    """Text of a PDF's pages, a blank line between them: by pymupdf where it is
    installed, else by this package's own reader."""
    try:
        import pymupdf
    except ImportError:
        return pdf.text

    def read(content: bytes) -> str:
        with pymupdf.open(stream=content, filetype="pdf") as opened:
            return "\n\n".join(page.get_text() for page in opened)

    return read


def pdf_texts(rows: DataFrame) -> DataFrame:
    """doc_id, rel_path, text and error of PDF rows (doc_id, rel_path,
    content). A file that cannot be read has an error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = pdf_reader()
        for batch in batches:
            texts, errors = [], []
            for content in batch.column("content").to_pylist():
                try:
                    texts.append(read(content))
                    errors.append(None)
                except Exception as error:
                    texts.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rel_path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["doc_id", "rel_path", "text", "error"])

    return rows.select("doc_id", "rel_path", "content").mapInArrow(run, "doc_id string, rel_path string, text string, error string")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def manifest_files(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.inline("files"))


def write_manifest(manifest: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(manifest, indent=2, sort_keys=True) + "\n")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A JSON line for each chunk; blank lines are passed over."""
    return spark.read.schema(CHUNKS).json(path).filter(F.col("doc_id").isNotNull())


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.select("chunk_index", "doc_id", "rel_path", "text").write.mode("overwrite").json(path)


QUARANTINE_LOG = "quarantine_log.tsv"


def keep_quarantined(rows: DataFrame, folder: Path) -> None:
    """Writes what is known of quarantined paths (rel_path, reason, sha256, name
    and content of those that were read): the bytes under their names and a log
    with tabs. Rows come to the driver a partition at a time. Files that an
    earlier log lists are deleted first, and nothing else."""
    log = folder / QUARANTINE_LOG
    if log.exists():
        for line in log.read_text().splitlines():
            (folder / line.split("\t")[0].replace("/", "__").replace("\\", "__")).unlink(missing_ok=True)
    folder.mkdir(parents=True, exist_ok=True)
    with log.open("w") as out:
        for row in rows.orderBy("rel_path").toLocalIterator():
            out.write(f"{row['rel_path']}\t{row['reason']}\t{row['sha256'] or ''}\n")
            if row["content"] is not None:
                (folder / row["name"]).write_bytes(row["content"])


def read_exemptions(spark: SparkSession, path: str | None) -> DataFrame:
    """rel_path of each exempted file; none without a path."""
    if path is None:
        return spark.createDataFrame([], "rel_path string")
    return spark.read.schema("rel_paths array<string>").option("multiLine", True).json(path).select(F.explode("rel_paths").alias("rel_path"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query and rel_doc from ``{"queries": [...]}`` or a bare list.
    A labelled set is small and made by hand, so the driver reads it."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    loaded = json.loads(text)
    items = loaded["queries"] if isinstance(loaded, dict) else loaded
    return spark.createDataFrame([(k, q["query"], q["rel_doc"]) for k, q in enumerate(items)], "query_id long, query string, rel_doc string")


def read_baseline(path: str | Path) -> dict[str, float]:
    loaded = json.loads(Path(path).read_text())
    return {k: float(loaded[k]) for k in ("recall_at_k", "precision_at_k", "mrr")}

"""Cutting texts into chunks of about 800 characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TARGET, LEAST = 800, 200
_GAP = re.compile(r"\n[ \t]*\n+")


def split_long(block: str, target: int) -> list[str]:
    """Pieces of at most ``target`` characters, cut at the last blank, newline
    or tab of the window if that lies in its second half, else at its end."""
    pieces, at, end = [], 0, len(block)
    while end - at > target:
        cut = max(block.rfind(c, at, at + target) for c in " \n\t") - at
        cut = at + (cut if cut > target // 2 else target)
        pieces.append(block[at:cut].strip())
        while cut < end and block[cut].isspace():
            cut += 1
        at = cut
    return [*pieces, block[at:]] if at < end else pieces


def groups(lengths: list[int], target: int) -> list[tuple[int, int, bool]]:
    """Ranges of blocks that make a chunk, from their lengths, and whether the
    range is one long block to be cut. A range ends before the first block that
    would take it beyond ``target`` (each counts two more, for the blank line)
    once it has ``LEAST``; a block longer than ``target`` is a range by itself."""
    bounds, start, filled = [], 0, 0
    for k, length in enumerate(lengths):
        long = length > target
        if start < k and (long or (filled >= LEAST and filled + length + 2 > target)):
            bounds.append((start, k, False))
            start, filled = k, 0
        filled += length + 2
        if long:
            bounds.append((k, k + 1, True))
            start, filled = k + 1, 0
    return [*bounds, (start, len(lengths), False)] if start < len(lengths) else bounds


def chunk_text(text: str, target: int = TARGET) -> list[str]:
    """Chunks of a text: its blocks between blank lines, gathered by ``groups``."""
    blocks = [b for b in map(str.strip, _GAP.split(text.replace("\r\n", "\n").replace("\r", "\n"))) if b]
    out: list[str] = []
    for start, end, long in groups(list(map(len, blocks)), target):
        out += split_long(blocks[start], target) if long else ["\n\n".join(blocks[start:end])]
    return out


def chunk_rows(docs: DataFrame, *keep: str, target: int = TARGET) -> DataFrame:
    """``keep``, chunk_index and text for each chunk of the rows' ``text``; a
    null text has none. One Arrow pass: the same cut by higher-order functions
    takes four times as long, as each step copies what is left of a text."""
    kept = docs.select(*keep, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                chunks = [chunk_text(t, target) if t else [] for t in batch.column("text").to_pylist()]
                rows = pa.array([k for k, c in enumerate(chunks) for _ in c], pa.int64())
                index = pa.array([n for c in chunks for n in range(len(c))], pa.int64())
                texts = pa.array([t for c in chunks for t in c], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in keep), index, texts], names=[*keep, "chunk_index", "text"])

    return kept.mapInArrow(cut, f"{kinds}, chunk_index long, text string")

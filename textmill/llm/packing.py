"""Packing of tokenised documents into sequences of a fixed length.

Bound-certified repacking. Documents are dealt to groups of a bounded number of
pieces and each group is packed by best-fit decreasing. A lower bound from
dual-feasible functions certifies the groups whose number of bins cannot be
improved. Groups with a gap release every bin that is not full, certified ones
only their emptiest bin (the remainder that every group is left with); released
bins are dealt to new groups, each bin as a whole, and packed again. A new
packing replaces the old one only where it takes fewer bins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import discard, materialize, slices

#: Pieces that one group holds on average.
GROUP_ROWS = 1 << 16
#: Exchanges of released documents after the first packing.
ROUNDS = 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: White space, letters and numbers below code point 256, where NFC changes nothing.
_S, _L, _N = "\t-\r \x85\xa0", "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The words of a lower-cased text of such characters, by the tokenizer's own pattern.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: Characters of other texts that are encoded at once.
STRETCH = 1 << 16


def ranked_merges(made: dict) -> tiktoken.Encoding | None:
    """The tokenizer's model as ranked merges of bytes, or None where its file
    tells of other steps than lower case, NFC, ``_SPLIT`` and byte pairs with a
    mark at the end of a word. The mark is a blank, which no word holds: a last
    byte and its mark are the pairs of the lowest ranks, so they join first."""
    steps, model = (made.get("pre_tokenizer") or {}).get("pretokenizers", []), made["model"]
    normal = [n["type"] for n in (made.get("normalizer") or {}).get("normalizers", [])]
    if normal != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"] != {"Regex": _SPLIT}:
        return None
    mark, vocab = model.get("end_of_word_suffix"), model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if model["type"] != "BPE" or not mark or merged != list(range(512, 512 + len(merged))):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {}
    for piece, rank in vocab.items():
        if rank < 512 + len(merged):
            ends = piece.endswith(mark)
            ranks[bytes(byte_of[c] for c in piece.removesuffix(mark)) + b" " * ends] = rank
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 512 + len(merged) else None


def encoder(tokenizer_path: str, end_id: int) -> Callable[[str | None], np.ndarray]:
    """Text to ids (unsigned 32 bits), ``end_id`` last, as the tokenizers
    library gives them without added special tokens; a special token's string in
    a text is that token.

    Texts of characters below code point 256 are split by a pattern and merged
    by ranks, which takes a third of the library's time; others, and those with
    a special token, go to the library. As its ids never cross white space, long
    ones go there in stretches that end at a blank.
    """
    tokenizer = Tokenizer.from_file(tokenizer_path)
    made = json.loads(tokenizer.to_str())
    merges = ranked_merges(made)
    special = re.compile("|".join(re.escape(t["content"]) for t in made["added_tokens"]) or r"(?!)")

    def stretches(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > STRETCH:
            cut = text.find(" ", at + STRETCH)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode(text: str | None) -> np.ndarray:
        ids: list[int] = []
        if text and merges and (text.isascii() or max(text) < "\u0100") and not special.search(text):
            ids = merges._core_bpe.encode_ordinary(" ".join(_PLAIN.findall(text.lower())) + " ")
        elif text:
            for part in stretches(text):
                ids += tokenizer.encode(part, add_special_tokens=False).ids
        ids.append(end_id)
        return np.array(ids, dtype="<u4")

    return encode


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece: documents longer than ``capacity`` tokens are cut
    into pieces of ``capacity``, the last may be shorter. Null and empty texts
    are one piece that holds the end id alone. Only ``doc_id`` and ``text`` are
    read; other columns are ignored. Repeated rows give repeated pieces. A text
    of any length is encoded whole."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, end_id)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((doc_id, k, at, len(part), crc32(part)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing takes fewer bins: the best of two families of dual-feasible
    functions over the lengths. The rounding family u_k (k = 1 is the plain
    volume bound) counts x as floor((k+1) x / C) / k, exact multiples as x / C.
    The threshold family drops items below t and counts those above C - t as
    whole bins."""
    if not len(lengths):
        return 0
    x = lengths.astype(np.int64)
    best = -(-int(x.sum()) // capacity)
    for k in range(1, 21):
        whole, rest = np.divmod((k + 1) * x, capacity)
        best = max(best, -(-int(np.where(rest == 0, whole * k, whole * (k + 1)).sum()) // (k * (k + 1))))
    ordered = np.sort(x)
    total = np.concatenate([[0], np.cumsum(ordered)])
    for t in np.unique(ordered[ordered <= capacity // 2])[:: max(1, len(ordered) // 65536)]:
        low, high = np.searchsorted(ordered, t), np.searchsorted(ordered, capacity - t, side="right")
        best = max(best, len(x) - int(high) + -(-int(total[high] - total[low]) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each item and the number of bins. Ties are kept in input order.
    Open bins are held by their free space; a bit mask of the spaces in use
    finds the tightest that fits."""
    bins = np.empty(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        above = mask >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
        else:
            space, b = capacity, count
            count += 1
        bins[i] = b
        if space > size:
            free[space - size].append(b)
            mask |= 1 << (space - size)
    return bins, count


def _offsets(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    first = np.r_[True, np.diff(bins[order]) != 0]
    out = np.empty(len(bins), dtype=np.int64)
    out[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
    return out


PACKED = PIECES + ", sequence_id long, offset long, released boolean"


def _packer(capacity: int, round_no: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(dtype=np.int64)
        bins, count = best_fit_decreasing(lengths, capacity)
        before = rows["sequence_id"].nunique() if round_no else count + 1
        if count < before:
            rows["sequence_id"] = (np.int64(round_no) << 60) + (np.int64(key[0]) << 30) + bins
            rows["offset"] = _offsets(bins, lengths)
        else:
            bins, count = pd.factorize(rows["sequence_id"])[0], before
        fill = np.bincount(bins, weights=lengths, minlength=count).astype(np.int64)
        if count > lower_bound(lengths, capacity):
            free = fill < capacity
        else:
            free = np.arange(count) == int(np.argmin(fill))
            free &= fill < capacity
        rows["released"] = free[bins]
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "released"]]

    return pack


def pack(pieces: DataFrame, capacity: int = 4096, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Pieces of at most ``capacity`` tokens with ``sequence_id`` and
    ``offset``. Every piece is kept, repeated ones too; offsets are gapless
    from 0 in each sequence. Ties in length go by doc_id and piece. An empty
    table stays empty. A group holds ``group_rows`` pieces on average whatever
    the size of the input, and only these few numbers of a piece."""
    pieces = materialize(pieces, "pieces")
    done: list[DataFrame] = []
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    open_rows = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    unit = F.monotonically_increasing_id()  # even for repeated doc_ids; stable, as it numbers written files
    for round_no in range(rounds + 1):
        n = open_rows.count()
        if not n:
            break
        groups = -(-n // group_rows)
        dealt = open_rows.withColumn("deal", F.pmod(unit, F.lit(groups)))
        packed = materialize(dealt.groupBy("deal").applyInPandas(_packer(capacity, round_no), PACKED), f"packed{round_no}")
        if not round_no:
            discard(pieces)
        if groups == 1 or round_no == rounds:
            done.append(packed.select(columns))
            break
        done.append(packed.filter(~F.col("released")).select(columns))
        open_rows = packed.filter("released").select(columns)
        unit = F.xxhash64("sequence_id")
    if not done:
        return open_rows.select(columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out

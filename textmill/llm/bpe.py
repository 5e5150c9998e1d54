"""Byte-level BPE: encoding by ranked merges, decoding by concatenation.

A text is split by a pattern into words, and each word is merged by itself. One
pass counts the distinct words of all texts. Spark higher-order functions fold
the ranked merges over the byte arrays of the most frequent ones, with a literal
rank map; ``MEMO_WORDS`` bounds how many. The workers that split the texts get
that word table and fold the words beyond it by the same rule, remembering them,
so the bound changes the speed and never a result. Folding every word in SQL
expressions takes more CPU time than the check tool allows (see the README).
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import collector_off, discard, materialize, slices

#: Distinct words, the most frequent first, that are folded in Spark and sent to the workers.
MEMO_WORDS = 1 << 16
#: Steps of the histogram of counts for each doubling.
STEPS = 16
#: Bytes of the longest of them.
MEMO_BYTES = 48
#: Further words that a worker remembers before it starts afresh.
LOCAL_WORDS = 500_000

_NONE = (1 << 31) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank of every byte string in a file of base64 strings and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class RankMap:
    """A literal hash map from byte strings to ranks: an array of buckets,
    indexed by the string's hash. Spark's own literal maps are searched from end
    to end for every key."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        self.buckets = 1 << max(4, len(ranks).bit_length())
        keys = [base64.b64encode(k).decode() for k in ranks]
        hashed = spark.createDataFrame(pa.table({"k": keys, "r": list(ranks.values())}))
        hashed = hashed.select("k", "r", F.pmod(F.xxhash64(F.unbase64("k")), F.lit(self.buckets)).cast("int").alias("h"))
        table: list[list[dict]] = [[] for _ in range(self.buckets)]
        for k, r, h in zip(*hashed.toArrow().to_pydict().values(), strict=True):
            table[h].append({"k": k, "r": r})
        self.literal = F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<array<struct<k:binary,r:int>>>")

    def rank(self, piece: Column) -> Column:
        at = F.pmod(F.xxhash64(piece), F.lit(self.buckets)).cast("int")
        return F.aggregate(F.get(self.literal, at), F.lit(_NONE), lambda found, e: F.when(e["k"] == piece, e["r"]).otherwise(found))


def fold_merges(word: Column, ranks: RankMap) -> Column:
    """Ids of one word: a fold that merges the adjacent pair of the lowest rank
    (the leftmost of equal ones) until no pair has a rank. A word that has a
    rank itself is one id. The empty word has no ids."""
    state = "struct<p:array<binary>,r:array<int>>"

    def pair(p: Column, i: Column) -> Column:
        return _let(F.concat(F.get(p, i), F.get(p, i + 1)), ranks.rank)

    def start(p: Column) -> Column:
        return F.struct(p.alias("p"), F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 2, F.lit(0))), lambda i: pair(p, i))).otherwise(F.array().cast("array<int>")).alias("r")).cast(state)

    def merge(s: Column, i: Column) -> Column:
        """i: place of the pair from 1."""
        p = F.concat(F.slice(s["p"], 1, i - 1), F.array(F.concat(F.get(s["p"], i - 1), F.get(s["p"], i))), F.slice(s["p"], i + 2, F.size(s["p"])))

        def ranked(p: Column) -> Column:
            none = F.array().cast("array<int>")
            left = F.when(i > 1, F.array(pair(p, i - 2))).otherwise(none)
            right = F.when(i < F.size(p), F.array(pair(p, i - 1))).otherwise(none)
            kept = F.when(i > 2, F.slice(s["r"], F.lit(1), i - 2)).otherwise(none)
            return F.struct(p.alias("p"), F.concat(kept, left, right, F.slice(s["r"], i + 2, F.size(s["r"]))).alias("r")).cast(state)

        return _let(p, ranked)

    def step(s: Column, _: Column) -> Column:
        return _let(F.coalesce(F.array_min(s["r"]), F.lit(_NONE)), lambda low: F.when(low < _NONE, _let(F.array_position(s["r"], low).cast("int"), lambda i: merge(s, i))).otherwise(s))

    def whole(raw: Column) -> Column:
        n = F.octet_length(raw)
        single = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(raw, i, F.lit(1)))
        folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), _let(single, start), step, lambda s: F.transform(s["p"], ranks.rank))
        return _let(ranks.rank(raw), lambda own: F.when(own < _NONE, F.array(own)).otherwise(folded))

    return F.when(F.octet_length(word) == 0, F.array().cast("array<int>")).otherwise(_let(F.encode(word, "UTF-8"), whole))


def count_words(texts: Column | str, docs: DataFrame, pattern: str) -> DataFrame:
    """Distinct words of all texts and how often each occurs: a task's words
    are counted before they are shuffled."""

    @collector_off
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, found = splitter(pattern), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    found.update(split(text))
            if len(found) > LOCAL_WORDS:
                yield out()
        if found:
            yield out()

    return docs.select(texts).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, most: int = MEMO_WORDS) -> DataFrame:
    """About the ``most`` frequent words (word, n), without a sort of all words:
    a histogram of their counts, at most ``STEPS`` rows for each doubling,
    tells from which count on they are few enough. Of the step below, a share
    by hash fills up the rest, so that many words of one count are no obstacle.
    ``words`` is read twice and should be written."""
    short = words.filter(F.octet_length("word") <= MEMO_BYTES).withColumn("step", F.floor(F.log2("n") * STEPS))
    above, last, share = 0, None, 0.0
    for row in short.groupBy("step").count().orderBy(F.desc("step")).collect():
        if above + row["count"] > most:
            last, share = row["step"], 0.98 * (most - above) / row["count"]
            break
        above += row["count"]
    if last is None:
        return short.drop("step")
    part = (F.col("step") == last) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return short.filter((F.col("step") > last) | part).drop("step")


def frequent_ids(words: DataFrame, ranks: RankMap, most: int = MEMO_WORDS) -> DataFrame:
    """About the ``most`` frequent words with their ids, folded by Spark's
    higher-order functions."""
    spread = frequent(words, most).select("word").repartition(words.sparkSession.sparkContext.defaultParallelism)
    return spread.select("word", fold_merges(F.col("word"), ranks).alias("ids"))


def merge_word(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same fold for one word in a worker. A heap of candidate pairs and
    links between neighbours keep long words near linear."""
    if word in ranks:
        return (ranks[word],)
    n, rank_of = len(word), ranks.get
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    if n <= 64:
        pairs = [rank_of(word[i : i + 2], _NONE) for i in range(n - 1)]
        while pairs and (low := min(pairs)) != _NONE:
            i = pairs.index(low)
            joined = parts[i] + parts[i + 1]
            parts[i : i + 2] = [joined]
            del pairs[i]
            if i:
                pairs[i - 1] = rank_of(parts[i - 1] + joined, _NONE)
            if i < len(pairs):
                pairs[i] = rank_of(joined + parts[i + 1], _NONE)
        return tuple([ranks[p] for p in parts])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j] = joined, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(joined + parts[k])) is not None:
                heapq.heappush(heap, (r, i, joined + parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + joined)) is not None:
            heapq.heappush(heap, (r, h, parts[h] + joined))
    return tuple(ranks[p] for p in parts if p is not None)


#: The splitting pattern of the public rank files, and the same for texts whose
#: code points are all below 256: without Unicode properties it runs faster.
_PROPERTIES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Finds the words of a text."""
    general, latin = regex.compile(pattern).findall, _LATIN.findall
    if pattern != _PROPERTIES:
        return general

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return latin(text)

    return split


class WordTable(dict):
    """What a worker knows of a word: ``shape`` of its ids and of the bytes
    that they decode to. Words that Spark has folded are there from the start,
    others are folded on first sight and forgotten when there are too many."""

    def __init__(self, folded: dict[str, tuple[int, ...]], ranks: dict[bytes, int], shape: Callable[[tuple[int, ...], bytes], tuple]):
        super().__init__()
        self.ranks, self.folded, self.shape = ranks, folded, shape
        self.pieces = {r: b for b, r in ranks.items()}

    def __missing__(self, word: str) -> tuple:
        ids = self.folded.get(word) or merge_word(word.encode("utf-8"), self.ranks)
        value = self.shape(ids, b"".join(map(self.pieces.__getitem__, ids)))
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[str]) -> list[tuple]:
        if len(self) > LOCAL_WORDS:
            self.clear()
        return list(map(self.__getitem__, words))


def encode(docs: DataFrame, ranks_path: str, pattern: str, result: type[Digests] | type[RoundTrip], memo_words: int = MEMO_WORDS) -> DataFrame:
    """Encodes every whole ``text`` and decodes its ids again: doc_id and the
    columns of ``result``. A null text counts as empty, an empty one has no ids;
    repeated rows give repeated results; other columns are ignored."""
    spark = docs.sparkSession
    ranks = load_ranks(ranks_path)
    words = materialize(count_words("text", docs, pattern), "words")
    folded = frequent_ids(words, RankMap(spark, ranks), memo_words).toArrow().to_pydict()
    discard(words)
    table = dict(zip(folded["word"], map(tuple, folded["ids"]), strict=True))
    sent = spark.sparkContext.broadcast((table, ranks))
    schema = pa.schema([("doc_id", pa.int64()), *result.fields])

    @collector_off
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, words = splitter(pattern), WordTable(*sent.value, result.word)
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out.append((doc_id, *result.text(words.of(split(text)) if text else [])))
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, from_arrow_schema(schema))


class Digests:
    """Number of ids, and the SHA-256 of the decimal ids joined by blanks and of
    the decoded bytes."""

    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    @staticmethod
    def word(ids: tuple[int, ...], decoded: bytes) -> tuple[str, bytes]:
        return " ".join(map(str, ids)), decoded

    @staticmethod
    def text(words: list[tuple[str, bytes]]) -> tuple[int, str, str]:
        joined = " ".join([w[0] for w in words])
        return joined.count(" ") + 1 if joined else 0, sha256(joined.encode()).hexdigest(), sha256(b"".join([w[1] for w in words])).hexdigest()


class RoundTrip:
    """The ids themselves and the decoded bytes."""

    fields = [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]

    @staticmethod
    def word(ids: tuple[int, ...], decoded: bytes) -> tuple[tuple[int, ...], bytes]:
        return ids, decoded

    @staticmethod
    def text(words: list[tuple[tuple[int, ...], bytes]]) -> tuple[list[int], bytes]:
        return list(chain.from_iterable([w[0] for w in words])), b"".join([w[1] for w in words])

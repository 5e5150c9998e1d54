"""Language identification by character language models.

For each language an interpolated Kneser-Ney model of character n-grams is
estimated from labelled texts. Models live in sorted hash arrays, a level for
each n-gram length: hashes of n-grams in ascending order, a row of
log-probabilities and of back-off weights (one column per language) for each;
``BLOCK`` languages share the arrays, whatever the number of languages. A text's
languages are ranked by length-normalised cross-entropy, the lowest is chosen.

Rejection is calibrated on labelled texts that the models have not seen: a text
is rejected beyond the cross-entropy that ``REJECT_QUANTILE`` of its language's
own held-out texts stay under. Short texts vary more, so the limit widens with
the inverse root of the length, as pieces of the same texts tell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import collector_off, slices

#: Length of the longest n-grams.
ORDER = 4
#: Labelled documents that a language's model is estimated and calibrated from, at most.
SAMPLE_DOCS = 300
#: Bytes of these at which no further document is added, so that the driver's share is bounded.
SAMPLE_BYTES = 1_500_000
#: Every so many-th of them calibrates, in the order of their hashes.
HELD = 5
#: Share of a language's held-out texts that are not rejected, and lengths of pieces that tell how limits widen.
REJECT_QUANTILE, PIECES = 0.995, (16, 64, 256)
#: Languages that share one set of arrays.
BLOCK = 16

_MIX = np.uint64(0x9E3779B97F4A7C15)
_EDGE = 0x110000


@dataclass
class Block:
    """levels[k]: sorted hashes of (k+1)-grams, their log-probabilities and the
    logs of the back-off weights of these n-grams as contexts, a column per
    language; unseen[l]: log-probability of a character never seen."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    unseen: np.ndarray


@dataclass
class Models:
    """Languages in order, their blocks, and a row per language of mean
    cross-entropy, widening and least limit (infinite where nothing is known)."""

    langs: list[str]
    blocks: list[Block]
    limits: np.ndarray

    def limit(self, lang: int, length: int) -> float:
        mean, widening, least = self.limits[lang]
        return max(least, mean + widening / max(1, length) ** 0.5)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text. Digits are one class, characters
    that are neither letters nor digits another, and runs of those count once;
    an edge mark stands on either side."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    table = _classes(codes)
    keep = np.r_[True, (table[1:] != 32) | (table[:-1] != 32)] if len(table) else np.zeros(0, bool)
    return np.concatenate([[_EDGE], table[keep], [_EDGE]])


_SMALL = np.array([ord(c) if c.isalpha() else 48 if c.isdigit() else 32 for c in map(chr, range(0x3000))], dtype=np.int64)


def _classes(codes: np.ndarray) -> np.ndarray:
    small = codes < 0x3000
    if small.all():
        return _SMALL[codes]
    out = np.where(small, _SMALL[np.where(small, codes, 0)], 0)
    wide = np.unique(codes[~small])
    kinds = np.array([c if chr(c).isalpha() else 48 if chr(c).isdigit() else 32 for c in wide.tolist()], dtype=np.int64)
    out[~small] = kinds[np.searchsorted(wide, codes[~small])]
    return out


def hashes(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1-grams to ``order``-grams that end at each place: entry
    [n][i] is that of chars[i-n : i+1]; the first n places have none (0)."""
    x = chars.astype(np.uint64) + np.uint64(1)
    out = [x * _MIX]
    for n in range(1, order):
        h = np.zeros(len(x), dtype=np.uint64)
        prev = out[-1]
        if len(x) > n:
            # the hash of the n-gram one place earlier, then this character
            mixed = prev[n - 1 : -1] ^ (prev[n - 1 : -1] >> np.uint64(29))
            h[n:] = (mixed + x[n:]) * _MIX
        out.append(h)
    return out


def _counts(texts: list[str], order: int) -> list[tuple[np.ndarray, ...]]:
    """For each n: hashes of the distinct n-grams, of their contexts (all but
    the last character) and of their suffixes (all but the first), and counts."""
    found: list[list[list[np.ndarray]]] = [[[], [], []] for _ in range(order)]
    for text in texts:
        c = characters(text)
        h = hashes(c, order)
        for n in range(order):
            found[n][0].append(h[n][n + 1 if n == 0 else n :])
            found[n][1].append(h[n - 1][n - 1 : -1] if n else np.zeros(max(0, len(c) - 1), np.uint64))
            found[n][2].append(h[n - 1][n:] if n else np.zeros(max(0, len(c) - 1), np.uint64))
    out = []
    for n in range(order):
        gram, ctx, suf = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found[n])
        keys, first, count = np.unique(gram, return_index=True, return_counts=True)
        out.append((keys, ctx[first], suf[first], count.astype(np.float64)))
    return out


def _kneser_ney(counts: list[tuple[np.ndarray, ...]]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], float]:
    """Probabilities of the n-grams of one language and the back-off weights of
    their contexts. Below the longest length an n-gram counts the different
    characters before it. The discount is n1 / (n1 + 2 n2) of its level."""
    order = len(counts)
    used = []
    for n, (keys, ctx, _, raw) in enumerate(counts):
        if n + 1 < order:
            left, times = np.unique(counts[n + 1][2], return_counts=True)
            at = np.searchsorted(left, keys)
            at[at == len(left)] = 0
            cont = np.where(left[at] == keys, times[at], 0).astype(np.float64) if len(left) else np.zeros(len(keys))
            used.append((keys, ctx, np.maximum(cont, 1.0)))
        else:
            used.append((keys, ctx, raw))
    out = []
    floor = 1.0 / max(1000, 4 * len(counts[0][0]))
    below: tuple[np.ndarray, np.ndarray] | None = None
    for n, (keys, ctx, c) in enumerate(used):
        n1, n2 = float((c == 1).sum()), float((c == 2).sum())
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        contexts, inverse = np.unique(ctx, return_inverse=True)
        total, kinds = np.bincount(inverse, c), np.bincount(inverse)
        weight = d * kinds / total
        if below is None:
            lower = np.full(len(keys), floor)
        else:
            suffix = counts[n][2]
            at = np.minimum(np.searchsorted(below[0], suffix), len(below[0]) - 1)
            lower = np.where(below[0][at] == suffix, below[1][at], floor)
        p = np.maximum(c - d, 0) / total[inverse] + weight[inverse] * lower
        out.append((keys, p, contexts, weight))
        below = (keys, p)
    start = float(out[0][3][0]) * floor if len(out[0][3]) else floor
    return out, start


def _block(samples: list[list[str]], order: int) -> Block:
    """A level holds the n-grams of all languages of the block. What one
    language has not seen of another's gets its back-off weight times its
    probability of the suffix, so that a single row answers for all of them and
    no language's answer depends on the others."""
    counted = [_counts(own or ["a"], order) for own in samples]
    each = [_kneser_ney(c) for c in counted]
    unseen = np.log(np.array([start for _, start in each])).astype(np.float32)
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for n in range(order):
        keys, first = np.unique(np.concatenate([c[n][0] for c in counted]), return_index=True)
        ctx, suf = (np.concatenate([c[n][k] for c in counted])[first] for k in (1, 2))
        logp = np.full((len(keys), len(samples)), np.nan, np.float32)
        back = np.zeros((len(keys), len(samples)), np.float32)
        for k, (model, _) in enumerate(each):
            logp[np.searchsorted(keys, model[n][0]), k] = np.log(model[n][1])
            if n + 1 < order:
                _, _, contexts, weight = model[n + 1]
                at = np.minimum(np.searchsorted(keys, contexts), len(keys) - 1)
                there = keys[at] == contexts
                back[at[there], k] = np.log(weight[there])
        if n == 0:
            fill = np.broadcast_to(unseen, logp.shape)
        else:
            below, low_p, low_back = levels[n - 1]
            at = np.minimum(np.searchsorted(below, suf), len(below) - 1)
            fill = np.where((below[at] == suf)[:, None], low_p[at], unseen)
            at = np.minimum(np.searchsorted(below, ctx), len(below) - 1)
            fill = fill + np.where((below[at] == ctx)[:, None], low_back[at], 0)
        levels.append((keys, np.where(np.isnan(logp), fill, logp).astype(np.float32), back))
    return Block(levels, unseen)


def fit(texts: dict[str, list[str]], order: int = ORDER) -> Models:
    """Models of the languages from their texts. Limits come from models that
    leave out every ``HELD``-th text, and from those texts; then all texts are
    learned. Texts without a letter add nothing; a language of fewer than
    ``HELD`` texts rejects none."""
    langs = sorted(texts)
    clean = [[t for t in texts[lang] if t and has_letter(t)] for lang in langs]

    def learned(samples: list[list[str]]) -> Models:
        return Models(langs, [_block(samples[i : i + BLOCK], order) for i in range(0, len(langs), BLOCK)], np.tile([0.0, 0.0, np.inf], (len(langs), 1)))

    partly, models = learned([[t for k, t in enumerate(own) if (k + 1) % HELD] for own in clean]), learned(clean)
    for k, own in enumerate(clean):
        if held := own[HELD - 1 :: HELD]:
            models.limits[k] = _calibrated(held, lambda t, k=k: float(cross_entropies(partly, t)[k]))
    return models


def _calibrated(held: list[str], entropy: Callable[[str], float]) -> tuple[float, float, float]:
    whole = np.array([entropy(t) for t in held])
    mean = float(whole.mean())
    pieces = [p for n in PIECES for t in held for p in (t[i : i + n] for i in range(0, min(len(t), 32 * n), n)) if has_letter(p)]
    wide = np.quantile([(entropy(p) - mean) * len(p) ** 0.5 for p in pieces], REJECT_QUANTILE)
    return mean, max(0.0, float(wide)), float(np.quantile(whole, REJECT_QUANTILE))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def cross_entropies(models: Models, text: str) -> np.ndarray:
    """Nats per character of a text in each language. Of every character the
    longest n-gram that any language of the block has seen is looked up; where
    there is none the context's back-off weight is added and the next shorter
    one is tried."""
    chars = characters(text)
    h = hashes(chars, len(models.blocks[0].levels))
    return np.concatenate([_total(block, h, len(chars)) for block in models.blocks]) / -max(1, len(chars) - 1)


def _total(block: Block, h: list[np.ndarray], n_chars: int) -> np.ndarray:
    order = len(block.levels)
    total = np.zeros(len(block.unseen))
    open_ = np.arange(order - 1, n_chars) if order > 1 else np.arange(1, n_chars)
    for n in range(order - 1, -1, -1):
        keys, logp, _ = block.levels[n]
        at, there = _find(keys, h[n][open_])
        total += logp[at[there]].sum(axis=0, dtype=np.float64)
        open_ = open_[~there]
        if n == 0:
            total += len(open_) * block.unseen.astype(np.float64)
            break
        at, there = _find(block.levels[n - 1][0], h[n - 1][open_ - 1])
        total += block.levels[n - 1][2][at[there]].sum(axis=0, dtype=np.float64)
        if 1 <= n - 1 < n_chars:
            open_ = np.r_[n - 1, open_]
    return total


def classify(models: Models, text: str | None) -> tuple[str, float, float | None, bool]:
    """Language, score (0 to 1: softmax of the cross-entropies), the best
    cross-entropy and whether it is rejected. Null texts, texts without a letter
    and any text where no language was learned are ``und``, score 0, rejected."""
    if not text or not models.langs or not has_letter(text):
        return "und", 0.0, None, True
    entropy = cross_entropies(models, text)
    best = int(np.argmin(entropy))
    score = 1.0 / float(np.exp(np.maximum(-20 * (entropy - entropy[best]), -700)).sum())
    return models.langs[best], score, float(entropy[best]), bool(entropy[best] > models.limit(best, len(text)))


def sample(labelled: DataFrame, per_lang: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """Texts to learn from: of each label the ``per_lang`` different texts with
    the smallest hashes, as long as those before them have fewer than
    ``most_bytes`` bytes. Nothing but text and label is looked at. A sketch of
    each label's different texts tells below which hash there are about twice as
    many as wanted, and only those hashes are shuffled, once each from a task;
    texts are read in a second pass for the chosen hashes alone. Null texts and
    labels are left out."""
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not found:
        return {}
    near = rows.filter(F.col("h") <= _limits({r["lang"]: (1 << 63) - 1 if r["n"] <= 2 * per_lang else int((2 * per_lang / r["n"]) * 2**64) - (1 << 63) for r in found}))
    hashed = near.groupBy("lang", "h").agg(F.max(F.octet_length("text")).cast("long").alias("size"))
    near = hashed.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= per_lang)
    order = Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    fitting = near.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).filter(F.col("before") < most_bytes)
    most = {r["lang"]: r["most"] for r in fitting.groupBy("lang").agg(F.max("h").alias("most")).collect()}
    chosen = rows.filter(F.col("h") <= _limits(most)).dropDuplicates(["lang", "h"]).toArrow().to_pydict()
    out: dict[str, list[str]] = {lang: [] for lang in most}
    for _, lang, text in sorted(zip(chosen["h"], chosen["lang"], chosen["text"], strict=True)):
        out[lang].append(text)
    return out


def _limits(of: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[F.col("lang")]


def predict(docs: DataFrame, models: Models, *keep: str) -> DataFrame:
    """``keep`` (doc_id and such), lang_pred, score, cross_entropy and rejected
    for every row. Only ``text`` is looked at, whole; equal texts get equal
    answers, ties go to the language that sorts first."""
    sent = docs.sparkSession.sparkContext.broadcast((models.langs, models.blocks, models.limits))
    kept = docs.select(*keep, "text")
    result = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])

    @collector_off
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Models(*sent.value)
        for batch in slices(batches):
            out = [classify(own, t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*out, strict=True)) or [()] * 4
            arrays = [pa.array(c, f.type) for c, f in zip(columns, result, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *arrays], names=[*keep, *result.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("text").schema)
    return kept.mapInArrow(run, f"{kinds}, lang_pred string, score double, cross_entropy double, rejected boolean")

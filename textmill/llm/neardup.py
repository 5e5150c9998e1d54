"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A document's signature has 128 symbols of 14 or 15 bits, taken from its
min-hashes; four symbols fill a long, a chunk, and 32 chunks are a signature.
Two signatures at most ``t`` symbols apart are found by the pigeonhole principle:
chunk errors e_1 .. e_32 are allowed so that the sum of (e_i + 1) exceeds t, hence
some chunk differs in no more than its allowed errors. Chunks with e_i = 0 are
looked up as they are, those with e_i = 1 once for each symbol left out. ``t`` is
the smallest distance that a pair at the similarity threshold exceeds with a
chance of at most ``MISS``.

Documents with equal shingle sets are one node from the start. Every node is
compared with one hub, the weightiest node of its buckets, on the full shingle
sets, which costs no more pairs than there are nodes. Nodes of the same hub are
then compared by what they differ from it in, exactly and without their texts:
first, a node in a small component with a few members of the large component of
its buckets; at last, where a bucket still holds several components, all nodes of
different ones, inside the join's condition. There the parities of 512 classes of
shingles come first: classes in which two nodes disagree cannot outnumber the
shingles that only one has, so a few machine words rule out nearly all pairs that
are not linked, and none that are. Pairs with different hubs are then filtered by
signature and confirmed on the texts. No pair within a component is ever expanded,
and no link that joins components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import collector_off, discard, materialize, slices

SYMBOLS, PER_CHUNK = 128, 4
CHUNKS = SYMBOLS // PER_CHUNK
#: Chance that a pair at the threshold is farther apart than the join looks.
MISS = 1e-5
#: Shingles in which a node differs from its hub, at most, to be compared with others by these; beyond, by texts.
DIFFERENCES = 512
#: Pairs of one document that meet in a task; its text is copied for each further such part.
SPLIT = 256
#: Documents of such pairs whose ids are sent to every task, so that other texts are not shuffled.
BROADCAST_IDS = 1 << 20
#: Longs that hold the parities of a set, a bit for each class of its shingles.
PARITIES = 8
#: Members of a bucket that meet its smaller parts in a task; these are copied for each further such number.
MEMBERS = 2048
#: Orders by which buckets suggest members of their largest part.
SUGGESTIONS = 6
#: Words whose hashes a worker remembers before it starts afresh.
MEMO_WORDS = 200_000

_SKETCH = "doc_id long, t long, n_shingles long, d0 long, d1 long, s array<long>, p array<long>"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Sets of hashed shingles: words are runs of anything but ASCII white
    space, A-Z lower-cased; a text with fewer words than a shingle has one."""

    def __init__(self, width: int):
        self.width, self.memo = width, _Words()
        self.odd = np.random.default_rng(3).integers(1, 1 << 63, size=width, dtype=np.uint64) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        h = np.fromiter(map(self.memo.__getitem__, words), dtype=np.uint64, count=len(words))
        w = min(self.width, len(h))
        if not w:
            return h
        n = len(h) - w + 1
        out = np.full(n, w, dtype=np.uint64)
        for k in range(w):
            out = (out ^ (out >> np.uint64(31))) * self.odd[k] + h[k : k + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Symbols (a row of 128 for each set) packed four to a long, with a spare
    bit above each; empty sets give zeros."""
    out = np.zeros((len(sets), SYMBOLS), dtype=np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        x = (np.concatenate([sets[k] for k in full]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(sets[k]) for k in full[:-1]])
        r = np.random.default_rng(5)
        a, b = r.integers(1, 1 << 32, SYMBOLS, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)
        for k in range(SYMBOLS):
            low = np.minimum.reduceat(x * a[k] + b[k], starts)
            low ^= low >> np.uint32(15)
            out[full, k] = ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    out &= np.array([0x7FFF, 0x7FFF, 0x7FFF, 0x3FFF] * CHUNKS, dtype=np.uint16)
    return out.view(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Whether a set has an odd number of shingles of each class, a bit a class
    (a row of ``PARITIES`` longs for each set)."""
    odd = np.zeros((len(sets), 64 * PARITIES), dtype=np.uint8)
    for k, s in enumerate(sets):
        odd[k] = np.bincount((s % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd, axis=1).view(np.int64)


def _lists(rows: np.ndarray) -> pa.ListArray:
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, a hash of the text (t), n_shingles, a digest of the set (d0, d1),
    the signature (s) and the parities (p) of every row."""

    @collector_off
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in slices(batches, 128):
            sets = [shingle(t) for t in batch.column("text").to_pylist()]
            digests = np.array([np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64) for s in sets]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), _lists(signatures(sets)), _lists(parities(sets))], names=["doc_id", "t", "n_shingles", "d0", "d1", "s", "p"])

    return _texts(docs).mapInArrow(run, _SKETCH)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def allowed_distance(percent: int, miss: float = MISS) -> int:
    """Smallest t with P(more than t of the symbols differ) <= miss at the threshold."""
    p, tail = 1 - percent / 100, 1.0
    for t in range(SYMBOLS + 1):
        tail -= comb(SYMBOLS, t) * p**t * (1 - p) ** (SYMBOLS - t)
        if tail <= miss:
            return t
    return SYMBOLS


def chunk_errors(distance: int) -> list[int]:
    """Errors allowed in each chunk: the sum of (e + 1) is distance + 1 or more."""
    least, more = divmod(max(distance + 1, CHUNKS), CHUNKS)
    errors = [least - 1 + (k < more) for k in range(CHUNKS)]
    if max(errors) >= PER_CHUNK:
        raise ValueError("the similarity is too low for the signature")
    return errors


def _lane_masks(errors: int) -> list[int]:
    """Masks that keep all symbols of a chunk but ``errors`` of them."""
    masks = [0xFFFF_FFFF_FFFF_FFFF]
    for _ in range(errors):
        masks = sorted({m & ~(0xFFFF << 16 * k) for m in masks for k in range(PER_CHUNK) if m >> 16 * k & 0xFFFF})
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def keys(s: Column, distance: int) -> Column:
    """Bucket keys of a signature: chunk, symbols left out, the other symbols."""
    found = []
    for c, e in enumerate(chunk_errors(distance)):
        for j, mask in enumerate(_lane_masks(e)):
            found.append(F.xxhash64(F.lit(c * 16 + j), F.get(s, F.lit(c)).bitwiseAND(F.lit(mask))))
    return F.array(*found)


def distance_between(a: Column, b: Column) -> Column:
    """Symbols in which two signatures differ: adding these constants carries
    into the spare bit of each lane that is not zero, and no farther."""
    spare, full = 0x4000_8000_8000_8000, 0x3FFF_7FFF_7FFF_7FFF
    lanes = F.zip_with(a, b, lambda x, y: F.bit_count((x.bitwiseXOR(y) + F.lit(full)).bitwiseAND(F.lit(spare))))
    return F.aggregate(lanes, F.lit(0), lambda n, d: n + d)


def _with_texts(pairs: DataFrame, a: str, b: str, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs with their texts, ta and tb. Texts are read for the documents
    in ``pairs`` only, and of rows that share a doc_id that of the node's hash;
    they are shuffled once. A document in more than ``SPLIT`` pairs is hot: its
    text is copied once for each such number, and its pairs are dealt to the
    copies by their other end. The join on b comes last, so that equal b follow
    each other and their set is made once."""
    involved = pairs.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("copies"))
    involved = materialize(involved.join(nodes.select("node", "t"), "node"), "involved")
    wanted = involved.withColumnRenamed("node", "doc_id")
    if involved.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    own = _texts(docs).join(wanted, ["doc_id", "t"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "copies")
    hot = involved.filter("copies > 1").select("node", "copies")

    def joined(rows: DataFrame, end: str, other: str, text: str) -> DataFrame:
        marked = rows.join(hot.select(F.col("node").alias(end), F.col("copies").alias("n")), end, "left")
        cold = marked.filter(F.col("n").isNull()).join(own.filter("copies = 1").select(F.col("doc_id").alias(end), F.col("text").alias(text)), end)
        dealt = own.filter("copies > 1").select(F.col("doc_id").alias(end), F.col("text").alias(text), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        split = marked.filter(F.col("n").isNotNull()).withColumn("copy", F.pmod(F.xxhash64(other), F.col("n")).cast("int")).join(dealt, [end, "copy"])
        return cold.drop("n").unionByName(split.drop("n", "copy"))

    return joined(joined(pairs.select(a, b), a, b, "ta"), b, a, "tb").select(a, b, "ta", "tb")


def confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    @collector_off
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, own = Shingler(width), None, None
        for batch in slices(batches, 64):
            out = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                if own is None or b != last:
                    last, own = b, shingle(tb)
                other = shingle(ta)
                common = len(np.intersect1d(own, other, assume_unique=True))
                if common and 100 * common >= percent * (len(own) + len(other) - common):
                    out.append((a, b))
            columns = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return _with_texts(pairs, "a", "b", docs, nodes).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node in ``links`` (a,
    b). Each round takes the smallest root of the neighbours, then the root's
    root; rounds end when nothing changes."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"), F.lit(True).alias("changed")), "roots")
    while not roots.filter("changed").isEmpty():
        heard = edges.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        lower = roots.join(heard, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("before"), F.least("root", "m").alias("root"))
        parents = roots.select(F.col("node").alias("p"), F.col("root").alias("above"))
        jumped = lower.join(parents, F.col("root") == F.col("p"), "left").select("node", "before", F.least("root", "above").alias("root"))
        before, roots = roots, materialize(jumped.select("node", "root", (F.col("root") != F.col("before")).alias("changed")), "roots")
        discard(before)
    discard(edges)
    return roots


def stars(shared: DataFrame) -> DataFrame:
    """node and hub: of the nodes that share a bucket with it, a node's hub is
    the one of the largest weight, the number of nodes that it shares buckets
    with: an original meets more of its copies than these meet each other."""
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    order = F.struct("weight", (-F.col("node")).alias("minus"))
    top = shared.join(weight, "node").groupBy("key").agg(F.max(order).alias("hub"))
    best = shared.join(top, "key").groupBy("node").agg(F.max("hub").alias("hub"))
    return best.select("node", (-F.col("hub.minus")).alias("hub")).filter(F.col("node") != F.col("hub"))


def compare_with_hubs(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """node, hub, linked, and how the node's full shingle set differs from the
    hub's: the numbers of shingles gone and added, and the hashes of both (the
    lowest bit tells which; null if there are more than ``DIFFERENCES``)."""
    both = _with_texts(pairs, "node", "hub", docs, nodes)

    @collector_off
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, own = Shingler(width), None, None
        one = np.uint64(1)
        for batch in slices(batches, 64):
            out = []
            for node, hub, text, hub_text in zip(*(batch.column(c).to_pylist() for c in ("node", "hub", "ta", "tb")), strict=True):
                if own is None or hub != last:
                    last, own = hub, shingle(hub_text)
                other = shingle(text)
                common = np.intersect1d(own, other, assume_unique=True)
                gone, added = len(own) - len(common), len(other) - len(common)
                hashes = None
                if gone + added <= DIFFERENCES:
                    parts = np.setdiff1d(own, common, True) & ~one, np.setdiff1d(other, common, True) | one
                    hashes = np.concatenate(parts).view(np.int64)
                out.append((node, hub, 100 * len(common) >= percent * (len(common) + gone + added) and len(common) > 0, gone, added, hashes))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "hub", "linked", "gone", "added", "diff"])

    return both.mapInArrow(run, "node long, hub long, linked boolean, gone long, added long, diff array<long>")


def same_hub_link(a: str, b: str, percent: int) -> Column:
    """Whether two nodes with the same hub are linked, by their full sets: of
    x, what is neither added to the hub nor gone from y is common, besides what
    both have added; what both lack has been subtracted twice."""
    n_a, n_b = F.col(f"{a}_n"), F.col(f"{b}_n")
    least = n_a - F.col(f"{a}_added") - F.col(f"{b}_gone")

    def enough(common: Column) -> Column:
        return (100 + percent) * common >= percent * (n_a + n_b)

    most = least + F.least(f"{a}_gone", f"{b}_gone") + F.least(f"{a}_added", f"{b}_added")
    return enough(most) & enough(least + F.size(F.array_intersect(f"{a}_diff", f"{b}_diff")))


def comparable(a: str, b: str) -> Column:
    return (F.col(f"{a}_hub") == F.col(f"{b}_hub")) & F.col(f"{a}_diff").isNotNull() & F.col(f"{b}_diff").isNotNull()


def side(details: DataFrame, name: str, *more: str) -> DataFrame:
    return details.select(*more, *[F.col(c).alias(f"{name}_{c}") for c in details.columns if c not in more])


def open_buckets(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """key, k, node, hub, part of the buckets that hold several parts."""
    placed = shared.join(parts, "node").select("key", "k", "node", "hub", "part")
    several = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter(F.col("lo") < F.col("hi")).select("key")
    return materialize(placed.join(several, "key", "left_semi"), "open")


def suggestions(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of a node and a member of the largest other part among the
    bucket's nodes with the same hub: for each bucket of a node at most one, and
    by few different orders, so that buckets often suggest the same member."""
    order = F.struct(F.xxhash64("node", F.col("k") % SUGGESTIONS).alias("h"), "node")
    groups = placed.groupBy("key", "hub", "part").agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("pick"))
    top = groups.groupBy("key", "hub").agg(F.max(F.struct("n", "part", F.col("pick.node").alias("node"))).alias("top"), F.count(F.lit(1)).alias("parts")).filter(F.col("parts") > 1)
    return placed.join(top, ["key", "hub"]).filter(F.col("part") != F.col("top.part")).select(F.col("node").alias("a"), F.col("top.node").alias("b")).distinct()


def may_link(a: str, b: str, percent: int) -> Column:
    """False only if two nodes have too many different shingles for a link: each
    class of shingles with different parities holds one at least."""
    differ = sum((F.bit_count(F.col(f"{a}_p{i}").bitwiseXOR(F.col(f"{b}_p{i}"))) for i in range(PARITIES)), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col(f"{a}_n") + F.col(f"{b}_n"))


def first_meeting(a: Column, b: Column, k: Column, distance: int) -> Column:
    """Whether key number k is the first key of an unaltered chunk that two
    signatures share, or there is none; so a pair is taken from one bucket of
    theirs. The position stands here once, as Spark works out ahead of a
    condition, for every pair, what stands in it twice."""
    errors = chunk_errors(distance)
    if min(errors):
        return F.lit(True)
    start = errors.index(0)
    before = sum(len(_lane_masks(e)) for e in errors[:start])
    same = F.zip_with(F.slice(a, start + 1, CHUNKS), F.slice(b, start + 1, CHUNKS), lambda x, y: x == y)
    return F.array_position(same, F.lit(True)).isin(F.lit(0), k - before + 1)


def crossing(members: DataFrame, distance: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a bucket (key, k) and of different parts, and
    whether they are sure: linked by what they differ from their hub in, else
    close by their signatures. The cheap conditions come first. ``copies`` is in
    how many portions a bucket's members are dealt; those outside its largest
    part (not ``major``) go to each."""
    words = [F.get("p", F.lit(i)).alias(f"p{i}") for i in range(PARITIES)]
    wide = members.select(*[c for c in members.columns if c != "p"], *words)
    dealt = wide.withColumn("copy", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int")).drop("copies")
    copied = wide.filter(~F.col("major")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies", "k")
    a, b = side(dealt, "a", "key", "copy", "k"), side(copied, "b", "key", "copy")
    crosses = (a["key"] == b["key"]) & (a["copy"] == b["copy"]) & (F.col("a_part") != F.col("b_part")) & (F.col("a_major") | (F.col("a_part") < F.col("b_part")))
    tested = (F.col("a_hub") == F.col("b_node")) | (F.col("b_hub") == F.col("a_node"))
    sizes = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    near = F.when(comparable("a", "b"), same_hub_link("a", "b", percent)).otherwise(distance_between(F.col("a_s"), F.col("b_s")) <= distance)
    once = first_meeting(F.col("a_s"), F.col("b_s"), F.col("k"), distance)
    found = a.join(b, crosses & sizes & may_link("a", "b", percent) & ~tested & near & once)
    return found.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), comparable("a", "b").alias("sure")).distinct()


def classify(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents whose shingle sets (``width`` words) have an intersection of at
    least ``percent`` hundredths of their union are linked; component_id is the
    smallest doc_id reachable, kept says that it is the row's own. Null texts
    and texts without words have no shingles and are linked with nothing. Rows
    that share a doc_id are one document, linked by the text of the smallest
    hash among those with words, whatever the order and partitions; n_shingles
    is each row's own. A null doc_id stays alone and is kept. Empty tables give
    an empty result; other columns are ignored.
    """
    distance = allowed_distance(percent)
    rows = materialize(sketch(docs, width), "sketch")
    filled = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    own = filled.groupBy("doc_id").agg(F.min(F.struct("t", "d0", "d1")).alias("own"))
    own = materialize(own.select("doc_id", "own.*"), "own")
    classes = own.groupBy("d0", "d1").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.count(F.lit(1)).alias("copies")).select("first.*", "copies")
    # joined on the id too, so that a large group of copies does not meet in one task
    chosen = filled.join(classes, ["doc_id", "t"])
    nodes = materialize(chosen.select(F.col("doc_id").alias("node"), "t", F.col("n_shingles").alias("n"), "s", "p", "d0", "d1", "copies").dropDuplicates(["node"]), "nodes")

    keyed = nodes.select("node", F.posexplode(keys(F.col("s"), distance)).alias("k", "key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = materialize(keyed.join(counts, "key"), "buckets")

    compared = materialize(compare_with_hubs(stars(shared), docs, nodes, width, percent), "stars")
    none = F.array().cast("array<long>")
    details = nodes.join(compared, "node", "left").select("node", "n", "s", "p", F.coalesce("hub", "node").alias("hub"), F.coalesce("gone", F.lit(0)).alias("gone"), F.coalesce("added", F.lit(0)).alias("added"), F.when(F.col("hub").isNull(), none).otherwise(F.col("diff")).alias("diff"))
    details = materialize(details.join(shared.select("node").distinct(), "node", "left_semi"), "details")
    starred = materialize(compared.filter("linked").select(F.col("node").alias("a"), F.col("hub").alias("b")), "links")
    discard(compared)

    def opened(links: DataFrame) -> DataFrame:
        found = components(links)
        parts = details.select("node", "hub").join(found, "node", "left").select("node", "hub", F.coalesce("root", "node").alias("part"))
        placed = open_buckets(shared, parts)
        discard(found)
        return placed

    placed, flat = opened(starred), details.drop("s", "p")
    tried = suggestions(placed).join(side(flat, "a").withColumnRenamed("a_node", "a"), "a").join(side(flat, "b").withColumnRenamed("b_node", "b"), "b")
    suggested = materialize(tried.filter(comparable("a", "b") & same_hub_link("a", "b", percent)).select("a", "b"), "links")
    discard(placed)
    links = starred.unionByName(suggested)

    placed = opened(links)
    groups = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = groups.groupBy("key").agg(F.max(F.struct("n", "part")).alias("top"), F.ceil(F.sum("n") / MEMBERS).cast("int").alias("copies")).select("key", F.col("top.part").alias("largest"), "copies")
    members = materialize(placed.drop("hub").join(largest, "key").join(details, "node").withColumn("major", F.col("part") == F.col("largest")).drop("largest"), "members")
    discard(placed, shared, details)
    pairs = materialize(crossing(members, distance, percent), "pairs")
    discard(members)
    links = links.unionByName(pairs.filter("sure").select("a", "b"))
    unsure = pairs.filter(~F.col("sure")).select("a", "b")
    final = components(links.unionByName(confirm(unsure, docs, nodes, width, percent)))

    linked = nodes.join(final, "node", "left").filter((F.col("copies") > 1) | F.col("root").isNotNull()).select("d0", "d1", F.coalesce("root", "node").alias("component"))
    linked = materialize(linked, "linked")
    discard(nodes, starred, suggested, pairs, final)
    joined = rows.select("doc_id", "n_shingles").join(own.select("doc_id", "d0", "d1"), "doc_id", "left").join(linked, ["d0", "d1"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: The groups for shingles of three words and a similarity of 0.85, from all pairs that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i+2], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, w.doc_id) AS component_id, coalesce(m.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.node = w.doc_id
"""

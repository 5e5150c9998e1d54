import hashlib
import re
import urllib.error

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmill.functions import embed
from textmill.functions import text as T
from textmill.functions.chunking import chunk_rows, chunk_text
from textmill.functions.hashing import fingerprint


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").coalesce(1)
    return [r[1] for r in rows.select("i", expression(F.col("t"))).orderBy("i").collect()]


TEXTS = ["", " a ", "x\r\ny\rz", "Hello, World 42!", "\xa0padded 　", "K kelvin İstanbul", "# Title\nOne. Two! 3.5 rest", "a" * 900, "é" * 130 + " the end", "no match here"]


def test_tokens(spark):
    assert column(spark, TEXTS, T.tokens) == [re.findall("[a-z0-9]+", t.lower()) for t in TEXTS]


def test_strip_takes_unicode_space(spark):
    assert column(spark, TEXTS, T.strip) == [t.strip() for t in TEXTS]


def test_blocks(spark):
    texts = ["a\n\nb", "a\r\n \t\r\n\r\nb\n", "one\ntwo", "\n\n"]
    assert column(spark, texts, T.blocks) == [["a", "b"], ["a", "b"], ["one\ntwo"], []]


def test_sentences(spark):
    assert column(spark, ["# Title\nOne. Two! 3.5 rest", "  \n#\nend"], T.sentences) == [["Title", "One.", "Two!", "3.", "5 rest"], ["end"]]


def test_significant_tokens_and_threshold(spark):
    found = column(spark, ["what does this widget have", "is it", "widget Widget queue"], T.significant_tokens)
    assert found == [["widget"], ["is", "it"], ["widget", "queue"]]
    needed = column(spark, [" ".join(f"token{i}" for i in range(n)) for n in range(1, 10)], lambda t: T.needed_matches(T.tokens(t)))
    assert needed == [1, 2, 3, 3, 4, 5, 5, 6, 7]


def test_snippets(spark):
    long = "x" * 100 + " needle " + "y" * 100
    assert column(spark, [long, "short"], T.shortened) == [long[:60] + "..." + long[-60:] if len(long) > 123 else long, "short"]
    around = column(spark, [long, "needle", "z" * 70], lambda t: T.around(t, F.lit("needle")))
    assert around == ["..." + long[41:167] + "...", "needle", "z" * 60 + "..."]


def test_kinds(spark):
    names = ["a/b.MD", "x.markdown", "p.pdf", "a.b/c.txt", ".txt", "noext", "a.tar.gz", "s.PY"]
    assert column(spark, names, T.kind_of) == ["markdown", "markdown", "pdf", "text", "unknown", "unknown", "unknown", "text"]


def features(text):
    out = []
    for token in re.findall("[a-z0-9]+", text.lower()):
        marked = "^" + token + "$"
        out += ["w:" + token] + ["c3:" + marked[k : k + 3] for k in range(len(marked) - 2)]
    return out


def test_features(spark):
    assert column(spark, ["Ab c", ""], T.features) == [["w:ab", "c3:^ab", "c3:ab$", "w:c", "c3:^c$"], []]
    assert column(spark, TEXTS, T.features) == list(map(features, TEXTS))


def test_vectors_are_signed_sums_of_features(monkeypatch):
    monkeypatch.setattr(embed, "MEMO_TOKENS", 6)
    texts = [*TEXTS, "same word, same word", "a b c d e f g h i j"]
    for text, made in zip(texts, embed.HashedNgramEmbedder(32).embed(texts), strict=True):
        sums = [0] * 32
        for f in features(text):
            digest = hashlib.blake2b(f.encode(), digest_size=8).digest()
            sums[int.from_bytes(digest[:4], "big") % 32] += 1 if digest[4] % 2 else -1
        length = sum(x * x for x in sums) ** 0.5
        assert made == pytest.approx([x / length if length else 0 for x in sums])
    assert embed.HashedNgramEmbedder(32).embed([]) == []


def test_chunks():
    assert chunk_text("") == [] and chunk_text("short") == ["short"]
    assert chunk_text("a\n\nb") == ["a\n\nb"]
    assert [len(c) for c in chunk_text("z" * 900)] == [800, 100]
    small, big = "s" * 150, "b" * 790
    assert chunk_text(f"{small}\n\n{big}") == [f"{small}\n\n{big}"]  # not closed below 200
    assert chunk_text(f"{'s' * 200}\n\n{big}") == ["s" * 200, big]
    assert chunk_text("w " * 500)[0] == ("w " * 400).strip()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\t\r.", max_size=3000))
def test_chunks_lose_no_word_and_stay_small(text):
    chunks = chunk_text(text, 100)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert all(c == c.strip() and c for c in chunks) and all(len(c) <= 303 for c in chunks)


def test_chunk_rows(spark):
    rows = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, "z" * 900)], "doc_id long, text string")
    assert [(r[0], r[1], len(r[2])) for r in chunk_rows(rows, "doc_id").orderBy("doc_id", "chunk_index").collect()] == [(1, 0, 4), (3, 0, 800), (3, 1, 100)]


def test_fingerprint_ignores_order_and_partitions(spark):
    rows = spark.range(100).withColumn("s", F.col("id").cast("string"))
    assert fingerprint(rows) == fingerprint(rows.orderBy(F.desc("id")).repartition(5)) != fingerprint(rows.filter("id > 0"))


def test_hashed_embedder():
    e = embed.local_embedder()
    a, b, c = e.embed(["widget authentication", "widget authentication token", "banana bread"])
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert len(a) == 384 and abs(dot(a, a) - 1) < 1e-9 and dot(a, b) > dot(a, c)
    assert e.embed_one("") == [0.0] * 384 and isinstance(e, embed.Embedder)
    with pytest.raises(embed.EmbeddingConfigError):
        embed.HashedNgramEmbedder(0)


def test_http_embedder():
    import json

    def transport(url, headers, body, timeout):
        assert url == "http://x/v1/embeddings" and headers["Authorization"] == "Bearer k"
        n = len(json.loads(body)["input"])
        return json.dumps({"data": [{"index": i, "embedding": [float(i + 1)] * 8} for i in reversed(range(n))]}).encode()

    def broken(*_):
        raise OSError("down")

    lost = iter([OSError("reset"), urllib.error.HTTPError("u", 503, "busy", None, None)])

    def shaky(*given):
        for error in lost:
            raise error
        return transport(*given)

    assert embed.HttpEmbedder("http://x/v1", "m", "k", transport=shaky, wait=0).embed(["a"]) == [[1.0] * 8] and next(lost, None) is None
    asked = []

    def refused(*_):
        asked.append(1)
        raise urllib.error.HTTPError("u", 401, "no", None, None)

    with pytest.raises(embed.EmbeddingBackendError):
        embed.HttpEmbedder("http://x", "m", "k", transport=refused).embed(["a"])
    assert len(asked) == 1
    e = embed.HttpEmbedder("http://x/v1/", "m", "k", transport=transport)
    assert e.embed(["a", "b"]) == [[1.0] * 8, [2.0] * 8] and e.dim == 8
    meta = dict(embed.embedder_meta(e))
    assert "k" not in meta.values() and embed.embedder_of(meta, "k").dim == 8
    with pytest.raises(embed.EmbeddingBackendError):
        embed.HttpEmbedder("http://x", "m", "k", transport=broken, wait=0).embed(["a"])
    for missing in (("", "m", "k"), ("u", "", "k"), ("u", "m", "")):
        with pytest.raises(embed.EmbeddingConfigError):
            embed.HttpEmbedder(*missing)

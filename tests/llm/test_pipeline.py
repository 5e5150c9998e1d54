"""The pipeline against a brute-force version of its stages."""

import random
import re
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def passes(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 8)}
    return len(w) >= 20 and 100 * len(covered) <= 30 * len(w)


def without_boilerplate(rows):
    pages = {}
    for _, text, source in rows:
        pages.setdefault(source, set()).add(text)

    def stays(line, source):
        n = sum(line.strip(" ") in [x.strip(" ") for x in t.split("\n")] for t in pages[source])
        return not words(line) or n < 5 or n < 0.05 * len(pages[source])

    return [(i, "\n".join(x for x in text.split("\n") if stays(x, source)), source) for i, text, source in rows]


def first_of_groups(rows):
    sets = {i: {tuple(w[k : k + 5]) for w in [words(re.sub("[A-Z]", lambda m: m[0].lower(), text))] for k in range(max(1, len(w) - 4))} for i, text, _ in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return [r for r in rows if root[r[0]] == r[0]]


def make(r):
    prose = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    texts = [f"All rights reserved by the host\n{prose(40)}\n{prose(30)}" for _ in range(25)] + [prose(60) for _ in range(15)]
    texts += [t.replace(" w1", " v1", 2) for t in texts[:4]] + texts[25:28] + [texts[30].upper()]
    texts += [None, "", "too short", "a b c d e f g h " * 9, f"mail joe.doe@site.org {prose(30)}", f"{prose(30)} call +1 (555) 123-4567", prose(9000)]
    return [(i, t, None if i % 3 else "en", "b" if i % 9 == 4 else "a", 0) for i, t in enumerate(texts)]


def test_pipeline(spark, tmp_path):
    rows = make(random.Random(12))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [(i, t, s) for i, t, _, s, _ in rows if passes(t)]
    stages = [kept, without_boilerplate(kept)]
    stages.append(first_of_groups(stages[-1]))
    stages.append([(i, re.sub(r"\+1 \(555\) 123-4567", "[PHONE]", t.replace("joe.doe@site.org", "[EMAIL]")), s) for i, t, s in stages[-1]])
    assert len(rows) > len(stages[0]) > len(stages[2]) and stages[0] != stages[1] and stages[2] != stages[3]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, expected in enumerate(stages):
        made = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        assert made.columns == docs.columns
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert sorted((x["doc_id"], x["text"], x["source"]) for x in docs.collect()) == expected, corpus_pipeline.STAGES[k][0]
        assert all(x["n_chars"] == len(x["text"]) for x in docs.collect())

    tokenizer, bins, got = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}, {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
        got[x["doc_id"], x["piece"]] = (x["start"], x["length"], x["ids_crc32"])
    for i, text, _ in stages[-1]:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            assert got.pop((i, k)) == (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    assert not got
    for b in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(b)])]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 4096


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


def plain(rows, least, top, longest=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, own in f.items():
        kept = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        rows = []
        for p, a in kept.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in kept.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "in", "é", "É", "a b", "x\x1cy", "new", "york", "city", "hall", "힣"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 60))).replace("of", rng.choice(["of", "of.", "of\t", "of\n\r", "of;x"])),
             rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]
    rows += [(None, "en"), ("", "en"), (" \t\n.,", "de"), (None, None)] + [("New York City Hall\tnew  york! city", "en")] * 40
    return rows + [("deep blue sea of words " * 3000, "fr"), ("a" * 50_000, "fr")]


@pytest.mark.parametrize("limits", [{}, {"held": 300, "burst": 3}, {"bits": 64}, {"held": 40, "burst": 2, "bits": 128}])
def test_against_plain(spark, limits):
    from tablekit.llm.collocations import collocations
    rows = texts(len(limits))
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    out = collocations(docs, least=4, top=30, **limits)
    assert sorted(tuple(r) for r in out.collect()) == plain(rows, 4, 30)


def test_small_table_by_the_query(spark, sample, tmp_path):
    from tablekit.llm.queries import QUERIES
    out = QUERIES["op12_collocations"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in out) == plain([(r.text, r.lang) for r in sample.collect()], 100, 2000)


def test_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    from tablekit.llm.collocations import collocations
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(i, "one two three", "en") for i in range(5)], SCHEMA)
    more = docs.withColumns({c: F.lit("x") for c in ("phrase", "words", "ids", "n", "Prefix", "f")})
    got = [tuple(r) for r in collocations(more, least=2).collect()]
    assert got == [tuple(r) for r in collocations(docs, least=2).collect()] == [("en", 1, "one two three", 5, 5, 5, 15, 3000)]


def test_products_past_64_bits(spark):
    from tablekit.llm.collocations import scored
    a, l, r, n = 987_654_321_012, 1_234_567_890_123, 2_345_678_901_234, 876_543_210_987_654
    phrases = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r)], "lang string, phrase string, words int, f bigint")
    sizes = spark.createDataFrame([("en", n)], "lang string, n bigint")
    assert scored(phrases, sizes).first().score == 1000 * a * n // (l * r)


def test_trie_bursts_and_gives_subtrees():
    import struct

    from tablekit.llm.collocations import Node, Trie
    rng = random.Random(1)
    trie, want = Trie(burst=5), Counter()
    for _ in range(3000):
        ids = [rng.randint(0, 6) for _ in range(rng.randint(1, 5))]
        new = trie.add(ids[0], [struct.pack(f">{len(ids) - 1}I", *ids[1:])], [2])
        assert new == (tuple(ids) not in want)
        want[tuple(ids)] += 2
    assert isinstance(trie.root[3], Node) and trie.sizes[3] == sum(p[0] == 3 for p in want)
    for first in range(7):
        got = [((first, *struct.unpack(f">{len(rest) // 4}I", rest)), c) for rest, c in trie.taken(first)]
        assert got == sorted((p, c) for p, c in want.items() if p[0] == first)
    assert not trie.root and not trie.sizes

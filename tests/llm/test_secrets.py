"""Secret scans: the rules against plain expressions, the model against brute force."""

import hashlib
import itertools
import random
import re

import pytest

RULES = ((0, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
         (1, re.compile(r"AKIA[A-Z0-9]+")), (2, re.compile(r"[0-9a-f]+")))
LEAST = (12, 18, 16)


def plain_spans(text):
    out = []
    for kind, rule in RULES:
        for m in rule.finditer(text):
            if len(m[2] if kind == 0 else m[0]) >= LEAST[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def odd(rng, n):
    signs = [*"a1.=+-: _\"'é\nKKſ", "token", "Secret", "api_key", "APIKEY", "passwd", "password", "AKIA", "ABCD12", "0123456789abcdef", "deadbeef"]
    return "".join(rng.choices(signs, k=n))


def test_base_spans_are_the_rules():
    from tablekit.llm.secret_scan import base_spans
    rng = random.Random(4)
    for _ in range(6000):
        text = odd(rng, rng.randint(0, 30))
        assert base_spans(text) == plain_spans(text), text
    assert base_spans("token" + " " * 200_000 + "AKIA" * 3) == []
    assert base_spans("f" * 300_000) == [(0, 300_000, 2)]


def test_texts_left_in_the_jvm_have_nothing(spark):
    from pyspark.sql import functions as F

    from tablekit.llm.secret_scan import base_spans, chains, is_candidate
    rng = random.Random(8)
    texts = [odd(rng, rng.randint(0, 6)) for _ in range(4000)] + ["é" + "x" * 11 + "1", "internationalisation", "a1" * 6]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", is_candidate(F.col("text")).alias("c")).collect()
    assert all(r.c or not base_spans(r.text) and not list(chains(r.text)) for r in rows)
    assert not all(r.c for r in rows)


def test_viterbi_and_marginals_are_exact():
    from tablekit.llm.secret_scan import NEVER, START, marginals, steps, viterbi
    import math
    rng = random.Random(2)
    for n in (1, 2, 3, 5):
        emit = [[rng.gauss(0, 2) for _ in range(3)] for _ in range(n)]
        weights = {("step", k): [rng.gauss(0, 1) for _ in range(3)] for k in range(3)}
        step, barred = steps(weights), (1,) if n > 2 else ()

        def score(tags, margin=0.0, barred=()):
            total = START[tags[0]] + sum(e[t] for e, t in zip(emit, tags)) + sum(step[a][b] for a, b in zip(tags, tags[1:]))
            return NEVER if any(tags[t] for t in barred) else total - margin * tags.count(1)

        every = list(itertools.product(range(3), repeat=n))
        assert score(viterbi(emit, step, 0.7, barred), 0.7, barred) == pytest.approx(max(score(t, 0.7, barred) for t in every))
        whole = sum(math.exp(score(t)) for t in every)
        one, two = marginals(emit, step)
        for at in range(n):
            for k in range(3):
                assert one[at][k] == pytest.approx(sum(math.exp(score(t)) for t in every if t[at] == k) / whole)
        for at in range(n - 1):
            assert two[at][1][2] == pytest.approx(sum(math.exp(score(t)) for t in every if t[at:at + 2] == (1, 2)) / whole)


def best_reading(text, base, weights, margin):
    """Viterbi over every token of the text, feature by feature."""
    from tablekit.llm import secret_scan as S
    zero, out = (0.0, 0.0, 0.0), []
    for chain in S.chains(text):
        emit = [[sum(w) for w in zip(zero, *(weights.get(f, zero) for f in fs))] for fs in S.features(text, chain, S.file_features(text))]
        barred = [t for t, (start, end, _, _) in enumerate(chain) if any(a < end and start < b for a, b, _ in base)]
        for (start, end, _, _), tag in zip(chain, S.viterbi(emit, S.steps(weights), margin, barred)):
            if tag == S.BEGIN:
                out.append((start, end))
            elif tag == S.INSIDE:
                out[-1] = (out[-1][0], end)
    return out


def test_every_token_is_read(monkeypatch):
    from tablekit.llm import secret_scan as S
    rng = random.Random(12)
    text = "the key: hunter - é汉 a1\u3000b=\n"
    assert [text[t[0]:t[1]] for chain in S.chains(text) for t in chain] == ["the", "key", ":", "hunter", "-", "é", "汉", "a1", "b", "="]
    assert list(S.chains(" \n\u3000")) == [] == list(S.chains(""))
    some = ["Pa55", "the", "API_KEY", "a.b-c", "ab12/cd", "é", "汉", "\0", "²", "=", "{", "}", ":", "  ", "\n", "\u2028", "deadbeef" * 2, "x" * 30, "token=", "KEYS"]
    texts = ["", "a", " "] + [" ".join(rng.choices(some, k=rng.randint(1, 60))) + "".join(rng.choices(some, k=rng.randint(0, 20))) for _ in range(60)]
    found = 0
    for bias in (0.0, 1.5, 3.0):
        # any token may be a secret or a part of one
        weights = {f: [rng.gauss(0, 0.7) for _ in range(3)] for t in texts for c in S.chains(t) for fs in S.features(t, c, S.file_features(t)) for f in fs if rng.random() < 0.9}
        weights |= {"bias": [bias, 0.0, 0.0]} | {("step", k): [rng.gauss(0, 1) for _ in range(3)] for k in range(3)}
        bases = [S.base_spans(t) for t in texts]
        want = [best_reading(t, b, weights, 0.5) for t, b in zip(texts, bases)]
        for block, words in ((1 << 18, 1 << 18), (7, 5), (60, 20)):
            monkeypatch.setattr(S, "BLOCK", block)
            monkeypatch.setattr(S, "WORDS", words)
            assert S.Reader(weights, 0.5).spans(texts, bases) == want
        found += sum(text[a:b].isalpha() and b - a < 12 for text, spans in zip(texts, want) for a, b in spans)
    assert found > 20


def test_secrets_without_a_digit_are_found():
    from tablekit.llm import secret_scan as S
    rng = random.Random(3)
    words = ["the", "of", "letter", "and", "word", "house"]
    value = lambda n: "".join(rng.choices("QXZJKVWY", k=n))
    prose = lambda: " ".join(rng.choices(words, k=12))
    weights = S.train([f"{prose()} password: {value(12)} {prose()}" for _ in range(40)])
    secret = value(12)
    text = f"{prose()} pass word: {secret} {prose()}"
    at = text.index(secret)
    assert S.base_spans(text) == [] and S.added_spans(text, [], weights) == [(at, at + 12)]


def test_model_finds_what_the_rules_label(spark):
    """On half of the documents the model was not trained on, without the rules."""
    from tablekit.llm import secret_scan as S
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    weights = S.train([t for t in texts[::2] if t and next(S.chains(t), None)])
    hit = total = wrong = 0
    for text in texts[1::2]:
        gold = set(S.merged([(v, b) for _, b, _, v in S._matches(text or "")]))
        found = set(S.added_spans(text or "", [], weights))
        hit, total, wrong = hit + len(gold & found), total + len(gold), wrong + len(found - gold)
    print(total, hit, wrong)
    assert total > 10 and hit / total > 0.7 and wrong <= 0.1 * total


def test_query_and_edge_cases(spark, docs_of, odd_texts, sample):
    from tablekit.llm import secret_scan as S
    from tablekit.llm.queries import QUERIES
    out = QUERIES["op13_secrets"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in sample.collect()}
    assert len(out) == len(texts)
    for r in out:
        spans = plain_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in spans) for k in range(3))
        line = [f"{S.KINDS[k]}:{a}:{b}" for a, b, k in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("secret:")] == line
    weights = S.fit(sample)
    rng = random.Random(6)
    own = [*odd_texts, "x" * 400_000 + " token = 'abcdefabcdef12' " * 2, *(odd(rng, 60) for _ in range(40))]
    rows = {r.doc_id: r.spans for r in S.find_secrets(docs_of(own), weights).collect()}
    for i, text in enumerate(own):
        assert [(s.start, s.end, S.KINDS.index(s.kind)) for s in rows[i] if s.base] == plain_spans(text or "")
        added = [(s.start, s.end) for s in rows[i] if not s.base]
        assert all(b <= a2 or b2 <= a for a, b in added for s in rows[i] if s.base for a2, b2 in [(s.start, s.end)])
    assert S.train([]) == {} and S.find_secrets(docs_of([]), {}).count() == 0 and S.fit(docs_of([])) == {}


def test_lessons_are_the_least_hashes(spark):
    from pyspark.sql import functions as F

    from tablekit.llm import secret_scan as S
    rows = spark.range(3000).select(F.when(F.col("id") % 50 == 0, F.concat(F.lit("token: abcdefgh"), F.col("id"))).otherwise(F.concat(F.lit("w"), F.col("id"))).alias("text"))
    rows = rows.unionAll(rows).withColumn("h", F.xxhash64("text"))
    every = sorted({r.h for r in rows.filter(F.col("text").startswith("token")).collect()})
    assert len(every) == 60 and S.least_lessons(rows, 2) == every[:2] and S.least_lessons(rows, 50) == every[:50]
    assert S.least_lessons(rows, 61) == every and S.least_lessons(rows.limit(0), 5) == []


def test_clashing_columns(docs_of):
    from pyspark.sql import functions as F

    from tablekit.llm.secret_scan import find_secrets, fit
    docs = docs_of(["token = 0123456789abcdef0", "x"]).withColumns({c: F.lit(1) for c in ("spans", "h", "Kind")})
    assert sorted(len(r.spans) for r in find_secrets(docs, fit(docs)).collect()) == [0, 2]


def test_least_hashes(spark):
    from pyspark.sql import functions as F

    from tablekit.llm.common import least_hashes
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"))
    every = sorted(r.h for r in rows.collect())
    assert least_hashes(rows.unionAll(rows), 50) == every[:50]
    assert least_hashes(rows.filter("h > 0"), 50) == [h for h in every if h > 0][:50]
    assert least_hashes(rows.limit(3), 50) == sorted(r.h for r in rows.limit(3).collect()) and least_hashes(rows.limit(0), 5) == []

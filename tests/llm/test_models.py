"""Language identification, personal data, chat formatting and the pipeline."""

import random
import re

import numpy as np
import pytest

RULES = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    from tablekit.llm.pii import luhn
    out = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == 2 and 14 <= len(digits) <= 19 and luhn(digits) or kind == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_are_the_rules():
    from tablekit.llm.pii import base_spans
    rng = random.Random(3)
    signs = [*"a1.@+-() %_é\n", "12", "4316522678525456", "mail.com", "1.2.3.4", "+1 (743) 555-3824"]
    for _ in range(5000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 30)))
        assert base_spans(text) == plain_spans(text), text
    assert base_spans("1" * 200_000 + "@" + "." * 50_000) == []   # linear time


def test_ip_with_many_zeros():
    from tablekit.llm.pii import base_spans
    zeros = "0" * 5000
    for text, found in ((f"{zeros}1.2.{zeros}.255", True), (f"{zeros}256.1.1.1", False), (f"1.1.1.{'9' * 5000}", False)):
        assert ([s for s in base_spans(text) if s[2] == 1] == [(0, len(text), 1)]) == found


def test_pii_model_and_query(spark, docs_of, odd_texts, sample):
    from tablekit.llm import pii
    from tablekit.llm.queries import QUERIES
    weights = pii.fit(sample)
    rows = {r.doc_id: r for r in pii.find_spans(docs_of(odd_texts), weights).collect()}
    for i, text in enumerate(odd_texts):
        spans = [(s.start, s.end, pii.KINDS.index(s.kind)) for s in rows[i].spans if s.base]
        assert spans == plain_spans(text or "")
    assert pii.train([]) == {} and pii.find_spans(docs_of([]), {}).count() == 0
    masked = {r.doc_id: r for r in pii.masked(docs_of(odd_texts), weights).collect()}
    for i, text in enumerate(odd_texts):
        if text is None or not (plain_spans(text) or rows[i].spans):
            assert masked[i].text == text
        else:
            assert not plain_spans(masked[i].text) and masked[i].n_chars == len(masked[i].text)
    out = QUERIES["op9_pii"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in sample.collect()}
    for r in out:
        spans = plain_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in spans) for k in range(4))
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in spans} <= set(r.spans.split(","))


def test_pii_model_finds_what_the_rules_label(spark):
    """On half of the documents the model was not trained on, without the rules."""
    from tablekit.llm import pii
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    weights = pii.train(texts[::2])
    hit = total = wrong = 0
    for text in texts[1::2]:
        gold, found = set(pii.base_spans(text)), set(pii.added_spans(text, [], weights))
        hit, total, wrong = hit + len(gold & found), total + len(gold), wrong + len(found - gold)
    assert total > 20 and hit / total > 0.6 and wrong <= 0.1 * total


def test_decoding_is_the_best_segmentation():
    from tablekit.llm import pii
    text = "12 345 678 9012 34"
    (start, end), = pii.regions(text)
    n, segments = pii.lattice(text, start, end)
    rng = random.Random(1)
    weights = {f: [rng.uniform(-3, 9) for _ in pii.KINDS] for s in segments for f in pii.features(text, s[2], s[3])}
    score = {s[:2]: max(x) for s, x in zip(segments, pii.scored(text, segments, weights))}

    def best(i):
        if i == n:
            return 0.0
        return max([best(i + 1)] + [best(j) + score[i, j] - pii.MARGIN for j in range(i + 1, n + 1)
                                    if (i, j) in score and score[i, j] > pii.MARGIN])
    found = pii.added_spans(text, [], weights)
    atoms = {s[2:]: s[:2] for s in segments}
    assert abs(sum(score[atoms[a, b]] - pii.MARGIN for a, b, _ in found) - best(0)) < 1e-9


def test_marginals_are_exact():
    from tablekit.llm.langid import marginals
    rng = np.random.default_rng(0)
    starts = np.array([0, 3, 140, 141, 400])
    emit, step = rng.normal(size=(400, 3)).astype(np.float32), rng.normal(size=(3, 3))
    got = marginals(emit, starts, step)
    for a, b in zip(starts, starts[1:]):
        forward = [np.ones(3) / 3 @ np.exp(step) * np.exp(emit[a])]
        for t in range(a + 1, b):
            forward.append(forward[-1] / forward[-1].sum() @ np.exp(step) * np.exp(emit[t]))
        backward = [np.ones(3)]
        for t in range(b - 1, a, -1):
            x = np.exp(step) @ (np.exp(emit[t]) * backward[-1])
            backward.append(x / x.sum())
        want = np.array([x * y for x, y in zip(forward, backward[::-1])])
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_language_accuracy(spark):
    from tablekit.llm.queries import QUERIES
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op7_langid"](spark, path).join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_language_of_odd_texts(docs_of, odd_texts, sample):
    from tablekit.llm import langid
    model = langid.fit(sample)
    out = {r.doc_id: r for r in langid.identify(docs_of(odd_texts), model).collect()}
    for i, text in enumerate(odd_texts):
        known = any(c.isalpha() for c in text or "")
        assert (out[i].lang_pred != "und") == known and (out[i].score > 0) == known
        assert sum(r.words for r in out[i].runs) == len(langid.words_of(text or ""))
    kept = langid.keep_identified(docs_of(odd_texts), model, least=0.0)
    assert {r.doc_id for r in kept.collect()} == {i for i in out if out[i].lang_pred != "und"}
    assert langid.fit(docs_of(["a b", "c d"], langs=[None, None])) is None
    assert [r.lang_pred for r in langid.identify(docs_of(["a b"]), None).collect()] == ["und"]
    assert langid.identify(docs_of([]), model).count() == 0 and langid.keep_identified(docs_of([]), model).count() == 0


def test_language_sample_has_no_copies(docs_of, monkeypatch):
    from tablekit.llm import langid
    texts = [f"{chr(97 + k % 26) * 3} word{k}" for k in range(30)]
    rows = [(k, t) for k, t in enumerate([t for t in texts for _ in range(1 + 40 * (t < "ccc"))])]
    seen = []
    train = langid.train
    monkeypatch.setattr(langid, "train", lambda rows: seen.append(rows) or train(rows))
    langid.fit(docs_of(rows), per_lang=20)
    assert len(seen[0]) == 20 == len(set(seen[0]))


def test_language_of_long_texts_only(docs_of):
    """A label without a text of at most LONGEST characters; a short text goes before a long one."""
    from tablekit.llm import langid
    long = " ".join(f"zorg{k}" for k in range(4000))
    assert len(long) > langid.LONGEST
    model = langid.fit(docs_of([(0, "the old man and the sea"), (3, long), (7, "a man of the sea")], langs=["en", "zz", "en"]))
    assert model.langs == ["en", "zz"]
    assert langid.identify(docs_of([long]), model).first().lang_pred == "zz"


def test_code_switched_text(spark, docs_of):
    from tablekit.llm import langid
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars BETWEEN 800 AND 3000").collect()
    model = langid.train([(r.text, r.lang) for r in rows[::2]])
    by = {r.lang: langid.words_of(r.text)[:40] for r in rows[1::2]}
    text = " ".join(by["en"] + by["de"] + by["fr"])
    runs = langid.identify(docs_of([text]), model).first().runs
    label = [r.lang for r in runs for _ in range(r.words)]
    want = [x for x in ("en", "de", "fr") for _ in by[x]]
    assert np.mean([a == b for a, b in zip(label, want)]) > 0.9


def test_tool_calls(spark):
    from tablekit.llm.chat import link_tool_calls
    calls = spark.createDataFrame([
        (1, 0, "a", "t", '{"y":1, "x":[1,{"b":2,"a":1.5}]}', []), (1, 1, "b", "t", '{"x":"s"}', ["c"]), (1, 2, "c", "t", "no", ["b"]),
        (1, 3, "d", "u", "{}", ["a", "zz"]), (1, 4, "a", "t", "{}", None), (1, 5, None, None, None, None),
        (2, None, "q", "t", '{"x":[],"k":1}', []), (2, 3, "r", "t", '{"x":[]}', ["q", "q"]), (2, 2, "s", "t", '{"x":[]}', ["r", "q"])],
        "conv_id long, turn int, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, 9, "a", "late"), (1, 8, "a", "first"), (3, 1, "z", "o"), (None, 1, None, "o")],
                                    "conv_id long, turn int, call_id string, content string")
    out = link_tool_calls(calls, results, {"t": {"x": ("array", True), "y": ("integer", False)}}).collect()
    got = {(r.conv_id, r.turn, r.call_id): (r.level, r.status, r.faults) for r in out}
    assert got == {
        (1, 0, "a"): (0, "linked", []), (1, 1, "b"): (None, "cycle", ["x: not array"]), (1, 2, "c"): (None, "cycle", ["no object"]),
        (1, 3, "d"): (1, "invalid", ["unknown tool"]), (1, 4, "a"): (None, "duplicate", ["x: missing"]),
        (1, 5, None): (None, "unnamed", ["no object"]), (2, None, "q"): (0, "invalid", ["k: unknown field"]),
        (2, 3, "r"): (1, "open", []), (2, 2, "s"): (2, "open", []), (3, 1, "z"): (None, "orphan", []), (None, 1, None): (None, "orphan", [])}
    line = next(r.json for r in out if (r.conv_id, r.turn) == (1, 0))
    assert line == ('{"after":[],"arguments":{"x":[1,{"a":1.5,"b":2}],"y":1},"call_id":"a","conv_id":1,"level":0,'
                    '"name":"t","result":"first","turn":0}')
    assert link_tool_calls(calls.limit(0), results.limit(0), {}).count() == 0


def test_oracles(spark):
    import duckdb

    from tablekit.llm.queries import ORACLE, QUERIES
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    for key, sql in ORACLE.items():
        cur = con.execute(sql)
        cols = [d[0] for d in cur.description]
        frame = QUERIES[key](spark, path)
        assert sorted(frame.columns) == sorted(cols)
        assert sorted(map(repr, (tuple(r) for r in frame.select(*cols).collect()))) == sorted(map(repr, cur.fetchall()))


def test_pipeline(spark, sample, tmp_path):
    """Each stage on what the one before it kept, against a plain version."""
    import corpus_pipeline as pipeline

    from tablekit.llm import langid, pii
    from test_exact_packing_bpe import pieces_are_right
    from test_near_repeats import components, simhash
    path = "/root/testdata/sf0.001"
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "pii", "packing"]
    docs, seen = sample, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        seen.append(docs)
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == sample.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    rows = [{r.doc_id: r.text for r in d.collect()} for d in seen]
    found = langid.identify(sample, langid.fit(sample)).collect()
    assert set(rows[1]) == {r.doc_id for r in found if r.lang_pred != "und" and r.score >= 0.3}
    last = {}
    for i, t in sorted(rows[1].items()):
        last[t] = i
    assert set(rows[2]) == set(last.values())
    ids = sorted(rows[2])
    root = components([simhash(rows[2][i]) for i in ids])
    assert set(rows[3]) == {ids[r] for r in set(root)}
    assert set(rows[4]) == set(rows[3])
    for i, t in rows[3].items():
        assert not plain_spans(rows[4][i]) and (rows[4][i] == t or pii.base_spans(t) or "[" in rows[4][i])
    pieces_are_right(docs.collect(), list(rows[4].items()))
    whole = pipeline.run(spark, path)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in docs.collect())


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_of_odd_tables(spark, docs_of, odd_texts, empty):
    import corpus_pipeline as pipeline
    from pyspark.sql import functions as F
    docs = docs_of([] if empty else [*enumerate(odd_texts), (None, None), (2, "x y"), (2, "x y")], langs=None)
    extra = {"digest": F.lit(1), "point": F.lit("p"), "masked": F.lit(2), "accepted": F.lit(0), "rank": F.lit(1)}
    docs = docs.withColumns(extra)
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "")
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
    assert (docs.count() == 0) == empty

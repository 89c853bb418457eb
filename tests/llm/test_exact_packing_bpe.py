"""Exact dedup, packing and BPE against brute force."""

import hashlib
import zlib

import numpy as np
import pytest

vocabularies = pytest.importorskip("public_tokenizers")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def groups(rows):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    return by


def test_exact_dedup(docs_of, odd_texts):
    from tablekit.llm.exact_dedup import drop_duplicates, duplicate_groups
    rows = list(enumerate(odd_texts)) + [(100 + k, "hot") for k in range(60)] + [(None, "hot"), (None, "alone"), (7, "a" * 3000)]
    docs = docs_of(rows)
    by = groups(rows)
    for heavy in (1024, 2):   # two heavy digests only: the other path for most
        out = duplicate_groups(docs, heavy=heavy).collect()
        assert len(out) == len(rows)
        for t, ids in by.items():
            top = max([i for i in ids if i is not None], default=None)
            own = [r for r in out if r.text_sha256 == sha(t)]
            assert {(r.keep_id, r.group_size) for r in own} == {(top, len(ids))}
            assert [r.doc_id for r in own if r.kept] == [top]
        kept = drop_duplicates(docs, heavy=heavy)
        assert kept.columns == docs.columns
        assert sorted((r.text or "", str(r.doc_id)) for r in kept.collect()) == sorted(
            (t, str(max([i for i in ids if i is not None], default=None))) for t, ids in by.items())


def test_exact_dedup_clashing_columns(docs_of):
    from pyspark.sql import functions as F

    from tablekit.llm.exact_dedup import drop_duplicates
    docs = docs_of(["x", "x", "y"]).withColumns({"digest": F.lit(1), "Rank": F.lit(2), "keep_id": F.lit(3), "at": F.lit(4)})
    out = drop_duplicates(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_best_fit_is_tightest():
    from tablekit.llm.packing import best_fit
    rng = np.random.default_rng(0)
    lengths = sorted(rng.integers(1, 1024, 700).tolist(), reverse=True)
    placed, used = best_fit(lengths, 1024)
    room = {}
    for n, (window, offset) in zip(lengths, placed):
        fits = [r for r in room.values() if r >= n]
        left = room.get(window, 1024)
        assert left == (min(fits) if fits else 1024) and offset == 1024 - left
        room[window] = left - n
    assert used == len(room) and sum(lengths) / (used * 1024) > 0.95


def pieces_are_right(out, docs_rows):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    want = {}
    for i, t in docs_rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        want.setdefault(i, []).append(np.array(ids, "<u4"))
    total, windows = 0, {}
    for r in out:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for x in want[r.doc_id])
        total += r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert total == sum(len(x) for xs in want.values() for x in xs)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing(docs_of, odd_texts):
    from tablekit.llm.packing import pack
    from tablekit.llm.queries import byte_bpe_files
    rows = list(enumerate(odd_texts)) + [(None, "null id"), (3, "repeated id"), (3, "repeated id")]
    for buckets in (4096, 5):
        pieces_are_right(pack(docs_of(rows), bucket_rows=buckets, **byte_bpe_files()).collect(), rows)
    without_ranks = pack(docs_of(rows), path=byte_bpe_files()["path"])
    pieces_are_right(without_ranks.collect(), rows)
    assert pack(docs_of([]), **byte_bpe_files()).count() == 0


def test_packing_query(spark, sample):
    from tablekit.llm.queries import QUERIES
    out = QUERIES["op8_packing"](spark, "/root/testdata/sf0.001").collect()
    pieces_are_right(out, [(r.doc_id, r.text) for r in sample.collect()])


def bpe_rows_are_right(out, rows):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(vocabularies.path("word_bpe_49k.json"))
    texts = dict(rows)
    for r in out:
        ids = whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(whole.decode(ids, skip_special_tokens=False))


def test_bpe_query(spark, sample):
    from tablekit.llm.queries import QUERIES
    out = QUERIES["op10_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == sample.count()
    bpe_rows_are_right(out, [(r.doc_id, r.text) for r in sample.collect()])


def test_bpe_chunks_are_repaired(odd_texts):
    from tokenizers import Tokenizer

    from tablekit.llm import bpe
    path = vocabularies.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), bpe.ChunkedBpe(path)
    texts = [t or "" for t in odd_texts] + ["İstanbul ΣΑΣ é " * 300, "x\x1c\x1dy\x85z " * 200, "a" * 5000 + " b"]
    own.cuts = lambda ts: [list(range(1, len(t), 7)) for t in ts]   # cuts everywhere, inside words too
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, np.int32).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_bpe_empty(docs_of):
    from tablekit.llm.bpe import encode_decode
    path = vocabularies.path("word_bpe_49k.json")
    assert encode_decode(docs_of([]), path).count() == 0
    rows = encode_decode(docs_of([None, ""]), path).collect()
    assert [(r.ids, r.decoded) for r in rows] == [([], ""), ([], "")]

"""SimHash, substring and suffix-array dedup, fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(points):
    """Root number of each point, all pairs compared."""
    root = list(range(len(points)))
    for i, p in enumerate(points):
        for j in range(i):
            if bin(p ^ points[j]).count("1") <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash(docs_of, odd_texts):
    from tablekit.llm.simhash import drop_near_duplicates, near_groups
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") * 3 + str(rng.randint(0, 99)) for _ in range(400)]
    near = []
    for k in range(8):
        words = list(base)
        words[k * 7] = f"new{k}"
        near.append(" ".join(words))
    rows = list(enumerate(odd_texts[:25] + near)) + [(None, near[0]), (None, "only null")]
    points = [simhash(t) for _, t in rows]
    root = components(points)
    least = {r: min([i for (i, _), x in zip(rows, root) if x == r and i is not None], default=None) for r in root}
    out = near_groups(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == sorted(
        (str(i), f"{p:016x}", str(least[r])) for (i, _), p, r in zip(rows, points, root))
    kept = drop_near_duplicates(docs_of(rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(least[r]) for r in set(root))
    assert drop_near_duplicates(docs_of([])).count() == 0 and near_groups(docs_of([])).count() == 0


def test_anchors_lose_no_link(spark):
    from tablekit.llm.simhash import components_of
    rng = random.Random(2)
    points = {rng.getrandbits(64) for _ in range(60)}
    for p in list(points):
        for _ in range(12):   # chains of up to 3 flipped bits
            q = p
            for b in rng.sample(range(64), rng.randint(1, 3)):
                q ^= 1 << b
            points.add(q)
            p = q if rng.random() < 0.5 else p
    points = sorted(points)
    root = components(points)
    signed = [int(np.uint64(p).astype(np.int64)) for p in points]
    frame = spark.createDataFrame([(p, k) for k, p in enumerate(signed)], "point long, first long").repartition(5)
    found = {r.point: r.component_id for r in components_of(frame).collect()}
    assert [found[p] for p in signed] == root


def repeats(texts, length, words):
    """(units, removed, runs, sha) by comparing every window with all earlier ones."""
    seen, out = {}, []
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) if words else list((t or "").encode()) for t in texts]
    for i, u in enumerate(split):
        for k in range(len(u) - length + 1):
            seen.setdefault(tuple(u[k:k + length]), (i, k))
    for i, u in enumerate(split):
        gone = [False] * len(u)
        for k in range(len(u) - length + 1):
            first = seen[tuple(u[k:k + length])]
            if first[0] < i if words else first < (i, k):
                gone[k:k + length] = [True] * length
        left = [x for x, g in zip(u, gone) if not g]
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((len(u), sum(gone), runs, hashlib.sha256(b" ".join(left) if words else bytes(left)).hexdigest()))
    return out


def spans_of(frame):
    return [(r.n_units, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
            for r in sorted(frame.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))]


@pytest.mark.parametrize("words", [True, False])
def test_repeats(docs_of, odd_texts, words):
    from tablekit.llm.substring_dedup import substring_dedup
    from tablekit.llm.suffix_dedup import suffix_dedup
    rng = random.Random(3)
    texts = odd_texts[:14] + odd_texts[15:] + ["xy" * 400, "z " * 120, "z " * 90 + "end"]
    texts += [" ".join(rng.choices("abc", k=rng.randint(40, 200))) for _ in range(12)]
    dedup, length = (substring_dedup, 50) if words else (suffix_dedup, 100)
    assert spans_of(dedup(docs_of(texts))) == repeats(texts, length, words)
    # short windows over few letters: many ties, overlaps and shared anchors
    small = ["".join(rng.choices("ab ", k=rng.randint(0, 60))) for _ in range(40)]
    assert spans_of(dedup(docs_of(small), length=6, gram=2)) == repeats(small, 6, words)
    assert dedup(docs_of([])).count() == 0


def test_repeats_of_a_hot_passage(docs_of, monkeypatch):
    from tablekit.llm import repeats as module
    from tablekit.llm.substring_dedup import substring_dedup
    from tablekit.llm.suffix_dedup import suffix_dedup
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(n))
    passage = line(70)
    texts = [f"{line(rng.randint(1, 30))} {passage} {line(rng.randint(1, 30))}" for _ in range(120)]
    hot = []
    find = module._hot_anchors
    monkeypatch.setattr(module, "_hot_anchors", lambda *a: hot.append(find(*a)) or hot[-1])
    assert spans_of(substring_dedup(docs_of(texts))) == repeats(texts, 50, True)
    assert spans_of(suffix_dedup(docs_of(texts))) == repeats(texts, 100, False)
    assert hot[0] and hot[1]


def test_repeated_ids(docs_of):
    from tablekit.llm.substring_dedup import substring_dedup
    from tablekit.llm.suffix_dedup import suffix_dedup
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(None, text), (4, text), (4, text)]
    assert sorted(sum(s.end - s.start for s in r.spans) for r in substring_dedup(docs_of(rows)).collect()) == [0, 80, 80]
    assert sorted(sum(s.end - s.start for s in r.spans) for r in suffix_dedup(docs_of(rows)).collect()) == [0, len(text), len(text)]
    assert [len(r.spans) for r in substring_dedup(docs_of(rows[1:])).collect()] == [0, 0]


def test_maximal_repeats():
    from tablekit.llm.suffix_dedup import maximal_repeats
    from tablekit.llm.suffixes import common_prefixes, suffix_order
    rng = random.Random(6)
    for _ in range(30):
        text = np.array([rng.randint(0, 2) for _ in range(80)] + [9])
        sa, ranks = suffix_order(text, 100)
        assert sa.tolist() == sorted(range(81), key=lambda i: text[i:].tolist())
        lcp = common_prefixes(text, sa, ranks)
        left = np.concatenate([[-1], text[:-1]])
        found = {(n, tuple(sorted(sa[a:b + 1].tolist()))) for n, a, b in maximal_repeats(sa, lcp, left, 3)}
        want = set()
        t = "".join(map(str, text))
        for n in range(3, 80):
            for s in {t[i:i + n] for i in range(len(t) - n)}:
                at = [i for i in range(len(t)) if t.startswith(s, i)]
                if len(at) > 1 and len({t[i + n:i + n + 1] for i in at}) > 1 and len({t[i - 1] if i else "" for i in at}) > 1:
                    want.add((n, tuple(at)))
        assert found == want


def test_fm_index_backward_search():
    from tablekit.llm.substring_dedup import FMIndex
    rng = random.Random(7)
    values = np.array([rng.randint(2, 6) for _ in range(299)] + [1])
    index = FMIndex(values, 8)
    text = values.tolist()
    for _ in range(200):
        pattern = [rng.randint(2, 6) for _ in range(rng.randint(1, 6))]
        lo, hi = np.array([0]), np.array([300])
        for symbol in reversed(pattern):
            lo, hi = index.extend(lo, hi, np.array([symbol]))
        want = [i for i in range(301 - len(pattern)) if text[i:i + len(pattern)] == pattern]
        assert sorted(index.sa[lo[0]:max(lo[0], hi[0])].tolist()) == want


def fingerprint_rows(rows):
    rows = [(i, t or "") for i, t in rows]
    lines = lambda t: {x for x in t.split("\n") if x}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 4
        edited = t[:len(t) - n] + after[:n]
        yield (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(lines(t), lines(edited)), 9), round(alike(lines(t), lines(after)), 9))


def test_fingerprints(spark, docs_of, odd_texts, sample):
    from tablekit.llm.queries import QUERIES
    from tablekit.llm.fingerprints import fingerprints
    texts = odd_texts + ["\n".join(f"line {k}" for k in range(900)), "\n".join(f"line {k}" for k in range(40, 700))]
    out = sorted(fingerprints(docs_of(texts)).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), round(r.near_edited, 9), round(r.near_next, 9))
            for r in out] == list(fingerprint_rows(enumerate(texts)))
    prints = {}
    for t, r in zip(texts, out):
        assert prints.setdefault(t or "", r.fingerprint) == r.fingerprint
    assert fingerprints(docs_of([])).count() == 0
    one = fingerprints(docs_of([(None, "a\nb\nc\nd")])).collect()
    assert [(r.edited, r.near_next) for r in one] == [("a\nb\nc\na"[:6] + "a", 1.0)]
    out = sorted(QUERIES["op1_fingerprints"](spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.doc_id)
    rows = sorted((r.doc_id, r.text) for r in sample.collect())
    assert [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out] == list(fingerprint_rows(rows))


def test_fingerprints_of_long_lines(docs_of):
    """Texts in one line: sentences, words without an end, no blanks, one repeated pattern."""
    from tablekit.llm.fingerprints import PIECE, fingerprints, pieces
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    texts = [" ".join(word() + "." * (k % 9 == 8) for k in range(400)), " ".join(word() for _ in range(400)),
             "".join(rng.choices("abcdefghij0123456789", k=3000)), "x" * 2000, "".join(rng.choices("\u4e00\u4e8c\u4e09\u3002", k=1500))]
    rows = sorted(fingerprints(docs_of(texts)).collect(), key=lambda r: r.doc_id)
    assert all(r.near_edited == 0 and r.piece_near_edited > 0.4 for r in rows if r.doc_id != 3) and rows[3].piece_near_edited > 0
    of = lambda texts: [set(r.p) for r in docs_of(texts, parts=1).selectExpr(f"{pieces('text')} AS p", "doc_id").orderBy("doc_id").collect()]
    for r, a, b in zip(rows, of(texts), of([r.edited for r in rows])):
        assert abs(r.piece_near_edited - len(a & b) / len(a | b)) < 1e-9
    # an insertion in front leaves the rest
    one, other = of([texts[1], "new words in front " + texts[1]])
    assert len(one & other) >= len(one) - 2
    short = "a" * PIECE + "\n\nb"
    assert [len(x) for x in of([short, "", "\n \n"])] == [2, 0, 0]


def test_fingerprints_stay_in_sql(docs_of):
    from tablekit.llm.exact_dedup import duplicate_groups
    from tablekit.llm.fingerprints import fingerprints
    for frame in (fingerprints(docs_of(["a", "b"])), duplicate_groups(docs_of(["a", "b"]))):
        plan = frame._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_peeling_reports_failure(spark):
    from tablekit.llm.fingerprints import peeled, sketch, subtracted
    one, other = "sequence(1L, 60L)", "sequence(31L, 100L)"
    for segment, works in (("4", False), ("200", True)):
        left = subtracted(sketch(one, segment), sketch(other, segment))
        out = spark.sql(f"SELECT {peeled(left, segment)} AS x").first().x
        assert (out is not None) == works
    assert sorted((r.n, r.k) for r in out) == sorted([(1, k) for k in range(1, 31)] + [(-1, k) for k in range(61, 101)])


def test_suffix_kernel_covers_repeats_inside_repeats():
    from tablekit.llm.repeats import Rule
    from tablekit.llm.suffix_dedup import compare
    rng = random.Random(1)
    for _ in range(150):
        length = rng.choice([3, 5, 8])
        pieces = list(dict.fromkeys("".join(rng.choices("ab", k=rng.randint(length, 25))).encode() for _ in range(rng.randint(1, 6))))
        n = len(pieces)
        row, start, end = compare(pieces, np.arange(n), np.arange(n), np.zeros(n, np.int64),
                                  np.array([len(p) - length + 1 for p in pieces]), Rule(False, length, 2, True))
        got = {(int(r), k) for r, a, b in zip(row, start, end) for k in range(a, b)}
        seen, want = set(), set()
        for i, p in enumerate(pieces):
            for k in range(len(p) - length + 1):
                if p[k:k + length] in seen:
                    want |= {(i, j) for j in range(k, k + length)}
                seen.add(p[k:k + length])
        assert got == want

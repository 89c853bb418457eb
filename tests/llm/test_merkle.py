"""The Merkle manifest against a plain version."""

import hashlib
import zlib

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, at, digest):
    proof = []
    for nodes in tree[:-1]:
        run = nodes[at - at % 3:at - at % 3 + 3]
        proof += run[:at % 3] + run[at % 3 + 1:]
        digest = H(*run[:at % 3], digest, *run[at % 3 + 1:])
        at //= 3
    return proof, digest


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    trees = {}
    for s, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in own])
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, r in enumerate(by[s]):
            found = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                found = (*r[:4], r[4].replace("\n", ""))
            low, folded = path(trees[s], at, leaf(found))
            high, folded = path(top, k, folded)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H(*low, *high), folded, folded == top[-1][0]))
    return out


def spark_rows(docs, tmp_path):
    from tablekit.llm.queries import QUERIES
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op11_merkle_manifest"](docs.sparkSession, str(tmp_path)).collect()
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out]


def key(row):
    return tuple(str(v) for v in row)


def test_sources_of_many_sizes(spark, tmp_path):
    rows, n = [], 0
    for size, source in [(1, "one"), (2, "Two"), (3, "é"), (4, ""), (729, "z729"), (730, "z730"), (244, None), (2200, "hot")]:
        for k in range(size):
            n += 1
            rows.append((n * 7 % 5000, source, None if k % 5 == 0 else "en", k, None if k % 11 == 0 else f"line {k}\nnext\n" * (k % 4)))
    rows += [(None, "hot", None, None, None), (None, "hot", "de", None, "a\nb"), (1, "hot", None, None, "x"), (1, "hot", None, None, "x")]
    rows += [(9000 + k, f"s{k}", "en", 1, "t\n") for k in range(740)]     # more sources than one stored row holds
    out = spark_rows(spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], SCHEMA).repartition(7), tmp_path)
    assert sorted(out, key=key) == sorted(plain(rows), key=key)
    assert {True, False} == {r[-1] for r in out}


def test_single_row_and_very_long_text(spark, tmp_path):
    rows = [(2, "s", "en", 5, "word\n" * 200_000)]
    out = spark_rows(spark.createDataFrame([(2, rows[0][4], "en", "s", 5)], SCHEMA), tmp_path)
    assert out == plain(rows)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    from tablekit.llm.merkle import audited, manifest
    empty = spark.createDataFrame([], SCHEMA)
    assert audited(empty).collect() == [] and manifest(empty)[1] is None
    docs = spark.createDataFrame([(k, "a\nb", "en", "s", 3) for k in range(9)], SCHEMA)
    more = docs.withColumns({c: F.lit(1) for c in ("tree", "digest", "idx", "n", "Level", "salt", "leaf")})
    plain_rows = sorted((r.doc_id, bytes(r.folded), bytes(r.root)) for r in audited(docs).collect())
    assert sorted((r.doc_id, bytes(r.folded), bytes(r.root)) for r in audited(more).collect()) == plain_rows


def test_recursion_limit_is_given_back(spark):
    from tablekit.llm.merkle import audited
    conf = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(conf)
    audited(spark.createDataFrame([(1, "a", "en", "s", 1)], SCHEMA))
    assert spark.conf.get(conf) == before


@pytest.mark.parametrize("n", [5, 2000])
def test_stored_rows_are_linked(spark, n):
    from tablekit.llm.merkle import manifest
    docs = spark.createDataFrame([(k, f"t{k}", "en", "s", 2) for k in range(n)], SCHEMA)
    _, nodes = manifest(docs)
    rows = nodes.collect()
    have = {(r.tree, r.level, r.block) for r in rows}
    assert all(r.up_tree is None or (r.up_tree, r.up_level, r.up_block) in have for r in rows)
    assert sum(r.up_tree is None for r in rows) == 1

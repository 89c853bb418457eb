"""Merkle manifest of a table: built levels are stored as parent-linked node rows;
a recursive query climbs them from every leaf to the root.

A leaf is the digest of one row. The leaves of one tree (one source) stand by
ascending ``doc_id``; every three in a row become one node, the last run may be
shorter, until one node is left, the tree's subroot. The subroots, ordered by
source (null first), are the leaves of one more tree, whose last node is the root.

Stored node rows hold ``STRIDE`` levels each: the digests of up to 729 neighbours
and of the levels above them, with a link to the row above. So a recursion step
climbs six levels and a leaf reaches the root of 10^9 leaves in five. Row
numbers come from a range partitioning by (source, doc_id) and counts per
partition, so a source with a third of all rows is spread like the others. Rows
near the root, which all leaves read, are stored in as many copies as they have
``SPREAD`` leaves below.

Defined results: an empty table has no leaves and no root; a null source is a
tree of its own, a null doc_id comes first; rows that repeat a doc_id stand by
their digests (equal rows may change places); a tree of one leaf has this leaf
as its subroot. Other columns than those digested play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

#: Columns of a row that its leaf digests, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node; levels held by one stored row; leaves served by one copy of a stored row.
ARITY, STRIDE, SPREAD = 3, 6, 6561
WIDTH = ARITY ** STRIDE
TOP = "2"
#: Trees and partitions up to which their first numbers are broadcast.
FEW_STARTS = 50_000


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Digest (32 bytes) of the given values in their order: ``-`` for null, else
    the bytes of the value's text, a colon and the text."""
    texts = [c.cast("string") for c in columns.values()]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tree_of(source: Column) -> Column:
    """The name of a source's tree; names sort like the sources, null first."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` (place in its ``tree`` by ``order``) and ``n`` (rows
    of the tree). No task holds more than one range of (tree, order)."""
    keys = ["tree", *order]
    # within a sorted partition these ids have no gaps: partition number, then place
    ranged = saved(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .withColumn("id", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"part": F.shiftright("id", 33), "at": F.col("id").bitwiseAND((1 << 33) - 1)})
    by_tree = W.partitionBy("tree")
    before = by_tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = saved(ranged.groupBy("tree", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))
                   .select("tree", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                           F.sum("c").over(by_tree).alias("n")))
    # a row per partition and per tree: broadcast where that is few, else joined
    few = starts.count() <= FEW_STARTS
    return (ranged.join(F.broadcast(starts) if few else starts, ["tree", "part"])
            .withColumn("idx", F.col("at") + F.col("shift")).drop("id", "part", "at", "shift"))


def _up(nodes: str) -> str:
    """SQL: the level above an array of digests."""
    run = f"hex({nodes}[{ARITY} * j])"
    rest = "".join(f", coalesce(hex(get({nodes}, int({ARITY} * j + {k}))), '')" for k in range(1, ARITY))
    return (f"transform(sequence(0, int((size({nodes}) - 1) div {ARITY})), "
            f"j -> unhex(sha2(lower(concat({run}{rest})), 256)))")


def _built(leaves: DataFrame, most: int) -> list[DataFrame]:
    """Stored rows of the trees of ``leaves`` (tree, idx, n, leaves, digest, below),
    level by level, the largest tree having ``most`` leaves: tree, level, block,
    n (nodes of the tree there), leaves (of the tree), levels (digests, one array
    per level), below (leaves of the table)."""
    part, out = leaves, []
    heights = f"int({' + '.join(f'if(n > {ARITY ** k}, 1, 0)' for k in range(STRIDE))})"
    while most:
        level = len(out)
        blocks = (part.groupBy("tree", "n", "leaves", F.expr(f"idx div {WIDTH}").alias("block"))
                  .agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("own"), F.sum("below").alias("below"))
                  .withColumn("own", F.expr("transform(own, x -> x.digest)"))
                  .select("tree", F.lit(level).alias("level"), "block", "n", "leaves", "below", F.expr(
                      f"aggregate(array_repeat(0, {heights}), array(own), "
                      f"(s, x) -> concat(s, array(transform(array(element_at(s, -1)), a -> {_up('a')})[0])))").alias("levels")))
        out.append(saved(blocks))
        part = out[-1].filter(F.col("n") > WIDTH).select(
            "tree", F.col("block").alias("idx"), F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"), "leaves",
            F.expr("element_at(levels, -1)[0]").alias("digest"), "below")
        most = -(-most // WIDTH) if most > WIDTH else 0
    return out


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _copies(level: str, block: str) -> str:
    """SQL: copies of a row of a source's tree: one per ``SPREAD`` leaves below."""
    width = f"bigint(power({WIDTH}, {level} + 1))"
    return f"(least({width}, leaves - ({block}) * {width}) + {SPREAD - 1}) div {SPREAD}"


def manifest(docs: DataFrame, also: dict[str, Column] | None = None, tree: str = "source", order: str = "doc_id",
             columns: tuple = COLUMNS) -> tuple[DataFrame, DataFrame | None]:
    """(leaves, nodes) of the rows of ``docs``.

    leaves: doc_id (the column ``order``), tree, digest, idx, n, and the columns of ``also``.
    nodes: stored rows (tree, level, block, salt) with their digests (``levels``)
    and the link to the row above (up_tree, up_level, up_block, up_slot,
    up_copies; null at the root); None for an empty table."""
    also = also or {}
    rows = saved(docs.select(docs[order].alias("doc_id"), tree_of(docs[tree]).alias("tree"),
                             leaf_digest({c: docs[c] for c in columns}).alias("digest"),
                             *(c.alias(name) for name, c in also.items())))
    leaves = saved(placed(rows, ["doc_id", "digest"]))
    total, most = leaves.agg(F.count("*"), F.max("n")).first()
    if not total:
        return leaves, None
    own = _built(leaves.select("tree", "idx", "n", F.col("n").alias("leaves"), "digest", F.lit(1).cast("bigint").alias("below")), most)
    # the last row of each tree is a leaf of the uppermost tree, and links to its place there
    last = _all(own).filter(F.col("n") <= WIDTH).withColumnsRenamed({"tree": "of", "n": "own_n"}).withColumns(
        {"tree": F.lit(TOP), "digest": F.expr("element_at(levels, -1)[0]")})
    last = saved(placed(last, ["of"]))
    sources = last.agg(F.max("n")).first()[0]
    tops = _all(_built(last.select("tree", "idx", "n", F.col("n").alias("leaves"), "digest", "below"), sources))
    whole, beside = f"({total} + {SPREAD - 1}) div {SPREAD}", F.sum("below").over(W.partitionBy(F.expr(f"idx div {WIDTH}")))
    above = {"up_level": "level + 1", "up_block": f"block div {WIDTH}", "up_slot": f"int(block % {WIDTH})"}
    links = [
        _all(own).filter(F.col("n") > WIDTH).withColumns({
            "copies": F.expr(_copies("level", "block")), "up_tree": F.col("tree"), **{k: F.expr(v) for k, v in above.items()},
            "up_copies": F.expr(_copies("level + 1", f"block div {WIDTH}"))}),
        last.withColumns({
            "copies": F.expr(f"(below + {SPREAD - 1}) div {SPREAD}"), "up_tree": F.lit(TOP), "up_level": F.lit(0),
            "up_block": F.expr(f"idx div {WIDTH}"), "up_slot": F.expr(f"int(idx % {WIDTH})"),
            "up_copies": ((beside + SPREAD - 1) / SPREAD).cast("bigint")}).withColumn("tree", F.col("of")),
        tops.withColumns({
            "copies": F.expr(f"if(level = 0, (below + {SPREAD - 1}) div {SPREAD}, {whole})"),
            "up_tree": F.expr(f"if(n > {WIDTH}, tree, NULL)"), **{k: F.expr(v) for k, v in above.items()}, "up_copies": F.expr(whole)})]
    columns = ["tree", "level", "block", "copies", "levels", "up_tree", "up_level", "up_block", "up_slot", "up_copies"]
    nodes = _all([x.select(columns) for x in links]).withColumn("salt", F.explode(F.expr("sequence(0L, copies - 1)"))).drop("copies")
    # dealt out by what a step of the climb joins on
    return leaves, saved(nodes.repartition("tree", "level", "block", "salt"))


#: One step: fold the digest through the levels of the row, collecting the
#: siblings from left to right, and go on at the row above.
CLIMB = """
WITH RECURSIVE climb AS (
  SELECT leaf, tree, 0 AS level, idx div {width} AS block, int(idx % {width}) AS slot, 0L AS salt,
         xxhash64(tree, idx div {spread}) AS spread, start AS folded, X'' AS proof,
         CAST(NULL AS BINARY) AS subroot, CAST(NULL AS BINARY) AS root
  FROM {leaves}
  UNION ALL
  SELECT leaf, up_tree, up_level, up_block, up_slot, coalesce(pmod(spread, up_copies), 0L), spread,
         went.folded, concat(proof, went.proof),
         if(tree != '{top}' AND (up_tree IS NULL OR up_tree = '{top}'), digest, subroot), if(up_tree IS NULL, digest, root)
  FROM (SELECT c.leaf, c.tree, n.up_tree, n.up_level, n.up_block, n.up_slot, n.up_copies, c.spread, c.proof, c.subroot, c.root,
               element_at(n.levels, -1)[0] AS digest,
               aggregate(slice(n.levels, 1, size(n.levels) - 1),
                         named_struct('at', c.slot, 'folded', c.folded, 'proof', X''),
                         (s, a) -> named_struct(
                           'at', int(s.at div 3),
                           'folded', unhex(sha2(lower(hex(concat(
                             if(s.at % 3 = 0, s.folded, a[s.at - s.at % 3]),
                             if(s.at % 3 = 1, s.folded, coalesce(get(a, s.at - s.at % 3 + 1), X'')),
                             if(s.at % 3 = 2, s.folded, coalesce(get(a, s.at - s.at % 3 + 2), X''))))), 256)),
                           'proof', concat(s.proof,
                             if(s.at % 3 = 0, X'', a[s.at - s.at % 3]),
                             if(s.at % 3 = 1, X'', coalesce(get(a, s.at - s.at % 3 + 1), X'')),
                             if(s.at % 3 = 2, X'', coalesce(get(a, s.at - s.at % 3 + 2), X''))))) AS went
        FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.block = n.block AND c.salt = n.salt)
)
SELECT leaf.*, subroot, root, folded, {proof} AS proof FROM climb WHERE tree IS NULL
"""


#: The digest of a proof, in SQL.
PROOF_DIGEST = "unhex(sha2(lower(hex(proof)), 256))"


def climbed(leaves: DataFrame, nodes: DataFrame, start: str = "digest", keep: tuple = ("doc_id", "digest"),
            proof: str = "proof") -> DataFrame:
    """Per leaf: the columns ``keep``, subroot and root as stored, ``folded`` (the
    root recomputed from the digest in column ``start`` and the stored siblings)
    and ``proof`` (SQL on these siblings' digests, 32 bytes each; as they are, or
    what is to be kept of them)."""
    spark = leaves.sparkSession
    rows = leaves.select(F.struct(*keep).alias("leaf"), "tree", "idx", F.col(start).alias("start"))
    sql = CLIMB.format(width=WIDTH, spread=SPREAD, top=TOP, proof=proof, leaves="{leaves}", nodes="{nodes}")
    # the query visits every leaf once a step: the default limit of rows is for runaway recursions
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        return saved(spark.sql(sql, leaves=rows, nodes=nodes))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def tampered(docs: DataFrame) -> Column:
    """The leaf digest as found after the line ends were taken out of the text of
    every document with an even checksum of its id; null where nothing changed."""
    text = docs["text"].cast("string")
    hit = (F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    return F.when(hit, leaf_digest({c: F.replace(text, F.lit("\n"), F.lit("")) if c == "text" else docs[c] for c in COLUMNS}))


def audited(docs: DataFrame, proof: str = "proof") -> DataFrame:
    """doc_id, digest, subroot, root, folded, proof per row of ``docs``, climbing
    with the digests of the tampered texts against the manifest of the true ones."""
    leaves, nodes = manifest(docs, {"found": tampered(docs)})
    if nodes is None:
        empty = "CAST(NULL AS BINARY)"
        return leaves.selectExpr("doc_id", "digest", *(f"{empty} AS {c}" for c in ("subroot", "root", "folded", "proof")))
    leaves = leaves.withColumn("start", F.coalesce("found", "digest"))
    return climbed(leaves, nodes, "start", proof=proof)

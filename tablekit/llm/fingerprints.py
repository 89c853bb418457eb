"""Document fingerprints by invertible Bloom lookup sketches of paragraphs, in
DataFrame functions only.

A paragraph is a non-empty line; a document is the set of its paragraphs' 64-bit
digests. A line of more than ``PIECE`` characters is also cut by its content
(``pieces``), so that an edit leaves the pieces before and behind it as they
were; of the same text, paragraphs and pieces give two sets and two
fingerprints. A sketch has three segments of cells; every digest goes to one cell of
each, where counts are added and digests and their check hashes are combined by
exclusive or. The fingerprint is the sketch with ``BASE`` cells per segment.

Two versions are compared by subtracting their sketches cell by cell: what they
share cancels. Peeling then takes digests out of cells that hold just one, until
nothing is left; a failed peeling is retried with larger sketches (at last sized
by the paragraph counts, under other seeds; should all fail, the sets themselves
are compared). The number of differing digests gives the likeness of the sets
(their Jaccard coefficient); two documents without paragraphs are alike (1.0).

Defined results: a null text counts as empty; a null ``doc_id`` is the first;
rows that repeat a ``doc_id`` follow each other as in the input; the next
document of the last one is the first, so a single document is its own next one.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of

#: Longest line or sentence that is one piece (characters); words and characters
#: per piece, on average, of what is cut by hashes.
PIECE, WORDS_A_PIECE, CHARS_A_PIECE = 80, 16, 64
#: Ranges of documents per shuffle partition.
RANGES_A_TASK = 16
#: Cells per segment of the fingerprint; one digest in so many estimates a
#: difference; least cells per segment of a retry; most rounds of peeling.
BASE, STRATUM, ROOM, ROUNDS = 4, 8, 16, 64

CELL = "struct<i:int,n:int,k:bigint,h:bigint>"
CELLS = f"array<{CELL}>"


def _summed(entries: str, segment: str) -> str:
    """SQL: cells with one entry per place, empty ones left out, by place. An entry
    with a place (i) is a cell; one without (-1) is a digest that goes to one cell
    of each segment.

    Places are sorted as numbers, place << 32 | entry: structs would be compared
    field by field. Those of one place then stand side by side, and each run of
    them is added up."""
    def code(place: str) -> str:
        return f"(shiftleft(bigint({place}), 32) | bigint(x))"

    cells = ", ".join(code(f"{j} * ({segment}) + (shiftrightunsigned(c.h, {21 * j}) & 2097151) % ({segment})") for j in range(3))
    codes = f"sort_array(flatten(transform(entries, (c, x) -> if(c.i >= 0, array({code('c.i')}), array({cells})))))"
    runs = "filter(transform(codes, (c, j) -> if(j > 0 AND shiftright(c, 32) = shiftright(codes[j - 1], 32), -1, j)), j -> j >= 0)"
    entry = "entries[int({} & 4294967295L)]"
    first, here = entry.format("codes[a]"), entry.format("c")
    # transform(array(x), y -> ...)[0] names x
    more = (f"aggregate(slice(codes, a + 2, coalesce(get(runs, x + 1), size(codes)) - a - 1), named_struct('i', int(shiftright(codes[a], 32)), "
            f"'n', {first}.n, 'k', {first}.k, 'h', {first}.h), (s, c) -> transform(array({here}), e -> "
            "named_struct('i', s.i, 'n', s.n + e.n, 'k', s.k ^ e.k, 'h', s.h ^ e.h))[0])")
    one = (f"if(coalesce(get(runs, x + 1), size(codes)) = a + 1, transform(array({first}), e -> "
           f"named_struct('i', int(shiftright(codes[a], 32)), 'n', e.n, 'k', e.k, 'h', e.h))[0], {more})")
    return (f"transform(array(cast({entries} AS {CELLS})), entries -> transform(array({codes}), codes -> transform(array({runs}), runs -> "
            f"filter(transform(runs, (a, x) -> cast({one} AS {CELL})), c -> c.n != 0 OR c.k != 0 OR c.h != 0))[0])[0])[0]")


def _items(digests: str, side: int, seed: int) -> str:
    """SQL: digests as entries on one side, without a place."""
    return f"transform({digests}, d -> struct(-1 AS i, {side} AS n, d AS k, xxhash64(d, {seed}) AS h))"


def sketch(digests: str, segment: str, seed: int = 0) -> str:
    """SQL: the sketch of an array of digests."""
    return _summed(_items(digests, 1, seed), segment)


def subtracted(one: str, other: str) -> str:
    """SQL: sketch ``one`` less sketch ``other``."""
    return _summed(f"concat({one}, transform({other}, c -> struct(c.i AS i, -c.n AS n, c.k AS k, c.h AS h)))", "1")


def peeled(cells: str, segment: str, seed: int = 0) -> str:
    """SQL: of a difference, the digests with their side (n = 1 or -1: in the
    first or the second version only); null if peeling gets stuck."""
    def pure(n: int) -> str:
        # distinct as numbers, which are hashed; structs would be compared in pairs
        return f"array_distinct(transform(filter(s.left, c -> c.n = {n} AND c.h = xxhash64(c.k, {seed})), c -> c.k))"

    # taken out: each pure digest goes to its cells once more, on the other side
    after = _summed(f"concat(s.left, {_items('plus', -1, seed)}, {_items('minus', 1, seed)})", segment)
    out = "concat(s.out, transform(plus, k -> struct(1 AS n, k AS k)), transform(minus, k -> struct(-1 AS n, k AS k)))"
    # transform(array(x), y -> ...)[0] names x
    step = (f"transform(array({pure(1)}), plus -> transform(array({pure(-1)}), minus -> if(size(plus) + size(minus) = 0, "
            f"named_struct('left', s.left, 'out', s.out, 'on', false), "
            f"transform(array({after}), rest -> named_struct('left', rest, 'out', {out}, 'on', size(rest) > 0))[0]))[0])[0]")
    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('left', cast({cells} AS {CELLS}), "
            f"'out', cast(array() AS array<struct<n:int,k:bigint>>), 'on', size({cells}) > 0), "
            f"(s, r) -> if(s.on, {step}, s), s -> if(size(s.left) = 0, s.out, NULL))")


def estimated(one: str, other: str) -> str:
    """SQL: about how many digests are in one of two sets only, from the stratum of
    one in ``STRATUM`` digests (by their last bits)."""
    some = [f"filter({x}, d -> d & {STRATUM - 1} = 0)" for x in (one, other)]
    return f"{STRATUM} * (size(array_except({some[0]}, {some[1]})) + size(array_except({some[1]}, {some[0]})))"


def differing(one: str, other: str, fingerprints: tuple[str, str]) -> str:
    """SQL: number of digests that are in one of two sets only. The fingerprints
    are tried first; the next sketches have room for the estimated number (cells
    that stay empty take none), the last ones for both sets."""
    def attempt(segment: str, seed: int, sketches: tuple[str, str]) -> str:
        # the difference is computed once: transform(array(x), y -> ...)[0] names x
        return (f"transform(array({subtracted(*sketches)}), cells -> "
                f"array_size({peeled('cells', segment, seed)}))[0]")

    def sized(segment: str, seed: int) -> str:
        # both sketches are added up at once, with opposite signs: their difference
        cells = _summed(f"concat({_items(one, 1, seed)}, {_items(other, -1, seed)})", "m")
        return (f"transform(array({segment}), m -> transform(array({cells}), cells -> "
                f"array_size({peeled('cells', 'm', seed)}))[0])[0]")

    both = f"greatest(1, size({one}) + size({other}))"
    tries = [attempt(str(BASE), 0, fingerprints), sized(f"{ROOM} + {estimated(one, other)}", 1), sized(f"2 * {both}", 2)]
    exact = f"size(array_except({one}, {other})) + size(array_except({other}, {one}))"
    return f"coalesce({', '.join(tries)}, {exact})"


def likeness(one: str, other: str, fingerprints: tuple[str, str]) -> str:
    both = f"(size({one}) + size({other}))"
    return (f"transform(array({differing(one, other, fingerprints)}), d -> "
            f"if({both} = 0, 1D, double({both} - d) / double({both} + d)))[0]")


def written(cells: str) -> str:
    """SQL: a sketch as text, place:count:digest:check per cell."""
    return (f"array_join(transform({cells}, c -> concat_ws(':', string(c.i), string(c.n), "
            "lower(hex(c.k)), lower(hex(c.h)))), ',')")


LINES = "filter(split({}, '\\n', -1), p -> p != '')"
PARAGRAPHS = f"array_distinct(transform({LINES}, p -> xxhash64(p)))"


def pieces(text: str) -> str:
    """SQL: digests of the pieces of a text. Lines of more than ``PIECE``
    characters are cut behind sentence ends; what is still longer where the hash
    of two words in a row says so, then where that of four characters in a row
    does, and at last (text of one repeated pattern) every ``PIECE`` characters."""
    def cut(parts: str, name: str, into: str) -> str:
        return f"flatten(transform({parts}, {name} -> if(length({name}) <= {PIECE}, array({name}), {into})))"

    def marked(units: str, blank: str, near: int, most: int) -> str:
        # a line has no line end: it marks the cuts
        hashed = ", ".join(f"get(u, i + {k})" for k in range(near))
        return (f"split(transform(array({units}), u -> array_join(transform(u, (x, i) -> "
                f"if(pmod(xxhash64({hashed}), {most}) = 0, concat(x, '\\n'), x)), '{blank}'))[0], '\\n{blank}', -1)")

    parts = cut(LINES.format(text), "a", "split(a, '(?<=[.!?]) +|(?<=[\\u3002\\uff01\\uff1f])', -1)")
    parts = cut(parts, "b", marked("split(b, ' ', -1)", " ", 2, WORDS_A_PIECE))
    parts = cut(parts, "c", marked("split(c, '')", "", 4, CHARS_A_PIECE))
    parts = cut(parts, "d", f"regexp_extract_all(d, '(?s).{{1,{PIECE}}}', 0)")
    return f"array_distinct(transform(filter({parts}, p -> trim(p) != ''), p -> xxhash64(p)))"


def with_next(docs: DataFrame, own: dict[str, str]) -> DataFrame:
    """doc_id, text, the columns ``own`` (SQL over the text) and the next document's
    (next_...), by ascending doc_id (null first; of equal ids by a hash of the
    text). Documents are dealt into ranges of doc_id by quantiles, several per
    shuffle partition; the first row of each range also goes to the range
    before, as the one row that its last document needs."""
    spark = docs.sparkSession
    base = docs.select(docs["doc_id"], text_of(docs).alias("text")).withColumn("h", F.xxhash64("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = RANGES_A_TASK * tasks
    # a range's number and first row follow from doc_id and text, so every job finds the same
    ids = base.select("doc_id", "h")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    firsts = sorted((r["part"], r["first"]) for r in
                    ids.groupBy(part.alias("part")).agg(F.min(F.struct("doc_id", "h")).alias("first")).collect())
    # at most one row per range
    also = spark.createDataFrame([(first["doc_id"], first["h"], firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)],
                                 "first_id bigint, first_h bigint, before int")
    rows = base.withColumn("part", part)
    rows = rows.join(F.broadcast(also), rows["doc_id"].cast("bigint").eqNullSafe(also["first_id"]) & (rows["h"] == also["first_h"]), "left")
    rows = rows.select("*", *(F.expr(e).alias(name) for name, e in own.items())).withColumn(
        "copy", F.explode(F.expr("filter(array(struct(0 AS ghost, part AS at), struct(1 AS ghost, before AS at)), c -> c.at IS NOT NULL)")))
    order = W.partitionBy("copy.at").orderBy("copy.ghost", F.col("doc_id").asc_nulls_first(), "h")
    held = ("text", *own)
    # the work behind this shuffle is much more than its bytes: as many tasks as there are partitions
    return (rows.repartition(tasks, "copy.at").select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in held))
            .filter("copy.ghost = 0").select("doc_id", *held, *(f"next_{c}" for c in held)))


#: The two sets of a text, by prefix of their columns: paragraphs, and pieces.
FAMILIES = {"": lambda text: PARAGRAPHS.format(text), "piece_": pieces}


def fingerprints(docs: DataFrame, families: tuple = tuple(FAMILIES)) -> DataFrame:
    """doc_id, n_chars, edited (the text with its last quarter replaced by the
    next document's beginning), and per family fingerprint, edited_fingerprint,
    near_edited, near_next of each row of ``docs``: by paragraphs, and (piece_...)
    by pieces."""
    base = str(BASE)
    own = {f"{p}digests": FAMILIES[p]("text") for p in families}
    rows = with_next(docs, own).withColumn("n_chars", F.length("text").cast("bigint"))
    rows = rows.withColumn("edited", F.expr(
        "concat(substring(text, 1, int(n_chars - floor(n_chars / 4))), substring(next_text, 1, int(floor(n_chars / 4))))"))
    rows = rows.select("*", *(F.expr(FAMILIES[p]("edited")).alias(f"edited_{p}digests") for p in families))
    rows = rows.select("*", *(F.expr(sketch(f"{version}{p}digests", base)).alias(f"{version}{p}cells")
                              for p in families for version in ("", "edited_", "next_")))
    found = []
    for p in families:
        found += [F.expr(written(f"{p}cells")).alias(f"{p}fingerprint"),
                  F.expr(written(f"edited_{p}cells")).alias(f"{p}edited_fingerprint"),
                  *(F.expr(likeness(f"{p}digests", f"{version}_{p}digests", (f"{p}cells", f"{version}_{p}cells")))
                    .alias(f"{p}near_{version}") for version in ("edited", "next"))]
    return rows.select("doc_id", "n_chars", "edited", *found)

"""Phrase collocations: phrases of two words and more that are said more often than
the parts they can be cut into, per language, counted in HAT-tries.

Texts are split into pieces and words once; the words of about ``BLOCK`` bytes of
text are stored as numbers under a vocabulary of their own. Each task counts the
phrases of its blocks in a trie of word ids whose leaves are hash containers; a
container that grows past ``BURST`` entries bursts into one container per next
word, and when all of a task's containers hold ``HELD`` entries, its largest
subtrees are written out whole as runs, sorted by prefix, and forgotten. Runs of
one prefix (the hash of the first word and of a sixteenth of the second and third
words, so that a frequent word or pair spreads) are merged one prefix after the other.

Counting goes by length: words, then pairs, then longer phrases. A phrase is no more
frequent than any part of it, so a longer one is counted only where all its words
(pairs) can be frequent. What cannot is told by a filter of ``FILTER_BITS`` bits,
made from the frequent words (pairs); it lets every frequent one pass, and what
it lets pass besides only costs time. Counts are whole and exact at any size.

Defined results: a null text is empty, a null language is ``und``; an empty table
has no phrases. Repeated rows count as often as they occur. Other columns play no
part.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, text_of

BLOCK, BURST, HELD, FILTER_BITS, PROBES = 2 << 20, 4096, 1_000_000, 1 << 26, 3
LEAST, LONGEST, TOP = 100, 5, 2000
#: Least number of parts into which the runs are dealt for merging; words of text a part.
PREFIXES, WORDS_A_PREFIX = 4096, 1 << 18

#: Ends of pieces become 0xFF, which no UTF-8 text has; a tab is a blank.
MARKED = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\xff" * 10 + b" ")


class Numbers(dict):
    """Words in the order they were first seen, numbered from 0."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def encoded(texts: list[str]) -> tuple[bytes, bytes, int]:
    """(vocabulary, numbers, words) of texts: the distinct words, one blank apart;
    per word its number there from 1 on, 0 at the end of a piece; their count."""
    import numpy as np
    marked = "\n".join(texts).encode().lower().translate(MARKED).replace(b"\xff", b" \xff ").split()
    numbers = Numbers({b"\xff": 0})
    ids = np.fromiter(map(numbers.__getitem__, marked), "<u4", len(marked))
    vocabulary = list(numbers)[1:]
    return b" ".join(vocabulary), ids.astype(id_type(len(vocabulary))).tobytes(), int(np.count_nonzero(ids))


def id_type(words: int) -> str:
    """How a block with so many different words writes their numbers."""
    return "<u2" if words < 1 << 16 else "<u4"


def blocks_of(docs: DataFrame) -> DataFrame:
    """Encoded blocks of texts of one language: lang, vocabulary, ids, words."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        held: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def block(lang):
            vocabulary, ids, words = encoded(held.pop(lang))
            del sizes[lang]
            return pa.RecordBatch.from_pydict(
                {"lang": [lang], "vocabulary": pa.array([vocabulary], pa.binary()), "ids": pa.array([ids], pa.binary()), "words": [words]})

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= BLOCK:
                    yield block(lang)
                elif sum(sizes.values()) >= 8 * BLOCK:
                    yield block(max(sizes, key=sizes.get))
        for lang in list(held):
            yield block(lang)

    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), text_of(docs).alias("text"))
    return rows.filter("text != ''").mapInArrow(run, "lang string, vocabulary binary, ids binary, words bigint")


class Trie:
    """Counts of phrases, as bytes of four per word id: the first id leads to a
    container (dict: rest -> count) or, burst, to a node of such by the next id."""

    def __init__(self, burst: int = BURST):
        self.root: dict[int, dict | Node] = {}
        self.sizes: dict[int, int] = {}
        self.burst = burst

    def add(self, first: int, rests: list[bytes], counts: list[int]) -> int:
        """Adds phrases with the same first id; returns the number of new ones."""
        top = self.root.get(first)
        if top is None:
            top = self.root[first] = {}
        if type(top) is dict:
            before = len(top)
            for r, c in zip(rests, counts):
                top[r] = top.get(r, 0) + c
            new = len(top) - before
            if len(top) > self.burst:
                self.root[first] = Node(top, self.burst)
        else:
            new = sum(top.add(r, c) for r, c in zip(rests, counts))
        self.sizes[first] = self.sizes.get(first, 0) + new
        return new

    def taken(self, first: int) -> list[tuple[bytes, int]]:
        """Takes a whole subtree out: its (rest, count), by ids."""
        top = self.root.pop(first)
        del self.sizes[first]
        return sorted(top.items())


class Node:
    """A burst container: containers (or nodes) by the next id."""

    def __init__(self, entries: dict, burst: int):
        self.ends, self.below, self.burst = 0, {}, burst
        for r, c in entries.items():
            self.add(r, c)

    def add(self, rest: bytes, count: int) -> bool:
        if not rest:
            new, self.ends = not self.ends, self.ends + count
            return new
        head, tail = rest[:4], rest[4:]
        own = self.below.get(head)
        if own is None:
            own = self.below[head] = {}
        if type(own) is not dict:
            return own.add(tail, count)
        new = tail not in own
        own[tail] = own.get(tail, 0) + count
        if len(own) > self.burst:
            self.below[head] = Node(own, self.burst)
        return new

    def items(self) -> Iterator[tuple[bytes, int]]:
        if self.ends:
            yield b"", self.ends
        for head, own in self.below.items():
            for tail, count in own.items():
                yield head + tail, count


def word_hashes(lang: str, words: list[bytes]):
    import numpy as np
    import xxhash
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def paired(left, right):
    """Hashes of pairs of words (or of any two hashes)."""
    import numpy as np
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def places(hashes, bits: int):
    """The ``PROBES`` places of each hash in a filter."""
    import numpy as np
    step = hashes >> np.uint64(33) | np.uint64(1)
    return [(hashes + np.uint64(k) * step) % np.uint64(bits) for k in range(PROBES)]


def passing(hashes, words):
    """Which hashes the filter (an array of 64-bit words) lets pass."""
    import numpy as np
    out = np.ones(len(hashes), bool)
    for at in places(hashes, 64 * len(words)):
        out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


#: How the counts of a run are written, by its first byte.
COUNT_TYPES = ("u1", "<u4", "<u8")


def written_counts(counts) -> bytes:
    most = int(counts.max())
    kind = 0 if most < 1 << 8 else 1 if most < 1 << 32 else 2
    return bytes([kind]) + counts.astype(COUNT_TYPES[kind]).tobytes()


def joined(batches: Iterator, least: int) -> Iterator:
    """Runs (prefix, lang, phrases, counts) in order of prefix, merged: the phrases
    of each prefix that occur at least ``least`` times."""
    import numpy as np
    import pyarrow as pa
    at, held, out = None, {}, ([], [], [])

    def ended():
        for lang, own in held.items():
            some = [(phrase, n) for phrase, n in own.items() if n >= least]
            out[0].extend([lang] * len(some))
            out[1].extend(phrase for phrase, _ in some)
            out[2].extend(n for _, n in some)
        held.clear()

    def written():
        batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())],
                                           ["lang", "phrase", "f"])
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        for prefix, lang, phrases, counts in zip(*(batch.column(c).to_pylist() for c in ("prefix", "lang", "phrases", "counts"))):
            if prefix != at:
                ended()
                at = prefix
                if len(out[0]) > 50_000:
                    yield written()
            own, at_ = held.setdefault(lang, {}), 0
            counts = np.frombuffer(counts, COUNT_TYPES[counts[0]], offset=1).tolist()
            for group in phrases.split(b"\n"):
                head, *tails = group.split(b"\t")
                for tail in tails:
                    phrase = head + b" " + tail if tail else head
                    own[phrase] = own.get(phrase, 0) + counts[at_]
                    at_ += 1
    ended()
    yield written()


def counted(blocks: DataFrame, lengths: tuple, filters: dict, least: int, prefixes: int, held: int = HELD, burst: int = BURST) -> DataFrame:
    """lang, phrase (binary), f of the phrases of the given lengths that occur at
    least ``least`` times and whose words and pairs pass ``filters`` (by length:
    broadcast arrays). ``prefixes``: into how many parts phrases are dealt by
    their first word (and a sixteenth of the second and third words)."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        tries: dict[str, Trie] = {}
        numbers: dict[str, Numbers] = {}
        hashes: dict[str, list[int]] = {}
        total = 0

        def runs(least_held: int) -> Iterator:
            """The largest subtrees, until at most ``least_held`` entries are left."""
            nonlocal total
            order = sorted(((n, lang, first) for lang, t in tries.items() for first, n in t.sizes.items()), reverse=True)
            taken: dict[str, list] = {}
            for n, lang, first in order:
                if total <= least_held:
                    break
                total -= n
                taken.setdefault(lang, []).append((first, tries[lang].taken(first)))
            for lang, trees in taken.items():
                yield written(lang, trees)
            if not total:   # nothing refers to the numbers any more
                tries.clear(), numbers.clear(), hashes.clear()

        def written(lang, trees):
            names, codes = list(numbers[lang]), np.array(hashes[lang], np.uint64)
            tails, counts, firsts, seconds, thirds = [], [], [], [], []
            for first, entries in trees:
                ids = np.frombuffer(b"".join(rest for rest, _ in entries), ">u4").tolist()
                firsts += [first] * len(entries)
                at = 0
                for rest, count in entries:
                    own = ids[at:at + len(rest) // 4]
                    at += len(own)
                    tails.append(b" ".join([names[i] for i in own]) if own else b"")
                    counts.append(count)
                    seconds.append(own[0] if own else -1)
                    thirds.append(own[1] if len(own) > 1 else -1)
            first, second, third = np.array(firsts), np.array(seconds), np.array(thirds)
            part = codes[first] * np.uint64(31)
            part += np.where(second < 0, np.uint64(0), codes[second] & np.uint64(15))
            part += np.where(third < 0, np.uint64(0), (codes[third] & np.uint64(15)) << np.uint64(4))
            part = (paired(part, part) % np.uint64(prefixes)).astype(np.int64)
            order = np.argsort(part, kind="stable")      # by first word within a part
            part, first, counts = part[order], first[order], np.array(counts, np.int64)[order]
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            new = np.flatnonzero((np.diff(part) != 0) | (np.diff(first) != 0)) + 1
            order, groups = order.tolist(), [0, *new.tolist(), len(part)]
            # the phrases of a first word share it: word, then what follows it, one tab apart
            texts = [b"\t".join([names[first[a]], *(tails[i] for i in order[a:b])]) for a, b in zip(groups, groups[1:])]
            at = np.searchsorted(groups, cuts).tolist()
            sizes = [written_counts(counts[a:b]) for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([
                pa.array([lang] * (len(cuts) - 1), pa.string()), pa.array(part[cuts[:-1]]),
                pa.array([b"\n".join(texts[a:b]) for a, b in zip(at, at[1:])], pa.binary()),
                pa.array(sizes, pa.binary())], ["lang", "prefix", "phrases", "counts"])

        for batch in batches:
            for lang, vocabulary, ids in zip(*(batch.column(c).to_pylist() for c in ("lang", "vocabulary", "ids"))):
                words = vocabulary.split(b" ") if vocabulary else []
                a, own = np.frombuffer(ids, id_type(len(words))), word_hashes(lang, words)
                known = passing(own, filters[1].value) if 1 in filters else np.ones(len(words), bool)
                trie, number, codes = tries.setdefault(lang, Trie(burst)), numbers.setdefault(lang, Numbers()), hashes.setdefault(lang, [])
                task_ids = np.zeros(len(words) + 1, np.int64)
                for k in np.flatnonzero(known).tolist():
                    task_ids[k + 1] = number[words[k]] + 1
                    if len(codes) < len(number):
                        codes.append(int(own[k]))
                t = task_ids[a]
                pairs = np.ones(max(0, len(t) - 1), bool)
                if 2 in filters and len(t) > 1:
                    at = np.flatnonzero((t[:-1] > 0) & (t[1:] > 0))
                    by_word = np.concatenate([[np.uint64(0)], own])[a]
                    pairs[:] = False
                    pairs[at] = passing(paired(by_word[at], by_word[at + 1]), filters[2].value)
                at, code = np.flatnonzero(t > 0), None
                for n in range(1, max(lengths) + 1):
                    if n > 1:
                        # the phrases of n - 1 words that go on by one
                        more = at + n - 1 < len(t)
                        more[more] = (t[at[more] + n - 1] > 0) & pairs[at[more] + n - 2]
                        at, code = at[more], code[more]
                    key = t[at + n - 1] if code is None else code << 32 | t[at + n - 1]
                    _, one, code, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                    if n not in lengths or not len(at):
                        continue
                    rows = t[at[one][:, None] + np.arange(n)] - 1
                    first = rows[:, 0]
                    rests = rows[:, 1:].astype(">u4").reshape(len(rows), -1).view(f"V{4 * (n - 1)}").ravel().tolist() if n > 1 else [b""] * len(rows)
                    cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)]
                    count, heads = count.tolist(), first[cuts[:-1]].tolist()
                    for head, low, high in zip(heads, cuts, cuts[1:]):
                        total += trie.add(head, rests[low:high], count[low:high])
                if total > held:
                    yield from runs(held // 2)
        yield from runs(0)

    rows = blocks.select("lang", "vocabulary", "ids").mapInArrow(run, "lang string, prefix bigint, phrases binary, counts binary")
    return (rows.repartition("prefix").sortWithinPartitions("prefix")
            .mapInArrow(lambda batches: joined(batches, least), "lang string, phrase binary, f bigint"))


def filter_of(frequent: DataFrame, bits: int = FILTER_BITS):
    """Broadcast filter of the frequent words or pairs (lang, phrase): at most
    ``bits`` bits, however many there are."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            by: dict[str, list] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                by.setdefault(lang, []).append(phrase.split(b" "))
            for lang, own in by.items():
                h = word_hashes(lang, [p[0] for p in own])
                if len(own[0]) == 2:
                    h = paired(h, word_hashes(lang, [p[1] for p in own]))
                at = np.unique(np.concatenate(places(h, bits)))
                slot, one = np.unique(at >> np.uint64(6), return_index=True)
                word = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), one)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(word.view(np.int64))], ["slot", "word"])

    found = frequent.select("lang", "phrase").mapInArrow(run, "slot bigint, word bigint").groupBy("slot").agg(F.bit_or("word").alias("word"))
    words = np.zeros(bits // 64, np.int64)
    rows = found.toArrow()     # at most bits / 64 rows
    words[rows.column("slot").to_numpy()] = rows.column("word").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(words.view(np.uint64))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS,
                     held: int = HELD, burst: int = BURST) -> tuple[DataFrame, DataFrame]:
    """(phrases, sizes): lang, phrase, words, f of every phrase of 1 to ``longest``
    words said at least ``least`` times; lang, n (all word occurrences)."""
    blocks = saved(blocks_of(docs))
    sizes = blocks.groupBy("lang").agg(F.sum("words").alias("n"))
    prefixes = max(PREFIXES, (blocks.agg(F.sum("words")).first()[0] or 0) // WORDS_A_PREFIX)
    found, filters = [], {}
    for lengths in ((1,), (2,), tuple(range(3, longest + 1))):
        if lengths:
            found.append(saved(counted(blocks, lengths, dict(filters), least, prefixes, held, burst)))
            if lengths[0] < 3:
                filters[lengths[0]] = filter_of(found[-1], bits)
    phrases = found[0]
    for f in found[1:]:
        phrases = phrases.unionByName(f)
    phrases = phrases.withColumn("phrase", F.col("phrase").cast("string"))
    return phrases.withColumn("words", F.size(F.split("phrase", " "))), sizes


def scored(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per phrase of two words and more: lang, phrase, words, a, l, r, n, score of
    its weakest cut, in exact arithmetic (ties: the earliest cut)."""
    cuts = (phrases.filter("words > 1").withColumnRenamed("f", "a")
            .withColumn("word", F.split("phrase", " ")).withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
            .select("lang", "phrase", "words", "a", "k", F.expr("array_join(slice(word, 1, k), ' ')").alias("left"),
                    F.expr("array_join(slice(word, k + 1, words), ' ')").alias("right")))
    part = phrases.select("lang", "phrase", "f")
    cuts = (cuts.join(part.withColumnsRenamed({"phrase": "left", "f": "l"}), ["lang", "left"])
            .join(part.withColumnsRenamed({"phrase": "right", "f": "r"}), ["lang", "right"])
            .join(sizes, "lang"))
    whole = "cast({} AS decimal(19, 0))"
    score = f"(cast(1000 * {whole.format('a')} AS decimal(22, 0)) * cast(n AS decimal(16, 0))) div ({whole.format('l')} * {whole.format('r')})"
    return (cuts.withColumn("cut", F.expr(f"named_struct('score', {score}, 'k', k, 'l', l, 'r', r)"))
            .groupBy("lang", "phrase", "words", "a", "n").agg(F.min("cut").alias("cut"))
            .select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = 100, **limits) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases
    by score, a (both descending) and phrase. A phrase inside a longer one that
    has at least ``covered`` hundredths of its occurrences is left out."""
    phrases, sizes = frequent_phrases(docs, least, longest, **limits)
    # a phrase two words longer is no more frequent than the one between: one word is enough
    longer = (phrases.filter("words > 2").withColumn("word", F.split("phrase", " "))
              .select("lang", F.col("f").alias("most"), F.explode(F.expr(
                  "array(array_join(slice(word, 1, words - 1), ' '), array_join(slice(word, 2, words), ' '))")).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("most").alias("most")))
    rows = (scored(phrases, sizes).join(longer, ["lang", "phrase"], "left")
            .filter(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within 64 parts of each language, so that the last window has few rows
    some = rows.withColumn("nth", F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best)))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*best))
    return (some.filter(F.col("nth") <= top).withColumn("rank", rank).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))

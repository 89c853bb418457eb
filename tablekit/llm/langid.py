"""Language identification by a linear-chain conditional random field over words.

Each word gets a language label, so code-switched text is labelled piece by
piece. Emissions sum weights of hashed character n-grams of the marked word
(those with a mark are its affixes) and of a lexicon of training words; learned
transitions tie neighbours together; forward-backward gives every word's
marginals. A document's language has the largest sum of marginals, its score is
that sum's share.

Training takes at most ``PER_LANG`` different texts of each label (those of at
most ``LONGEST`` characters first, then the beginnings of longer ones; chosen by
hash of the text), mixed into code-switched sequences of ``SEQUENCE`` words. Prediction reads whole texts and nothing but
the text: long documents are cut into blocks whose transfer matrices carry the
messages across, so the marginals are those of the whole chain.

Defined results: a null text or one without a letter is ``und`` with score 0;
ties go to the first label in sorted order; without any labelled document every
text is ``und``. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, slices, text_batches, text_of, text_sizes

PER_LANG, LONGEST, SEQUENCE, PIECE, EPOCHS, BUCKETS, BLOCK = 150, 20_000, 64, 12, 25, 1 << 15, 64
WORDS_KEPT, SLICE_BYTES, UNKNOWN = 150_000, 1 << 19, "und"
WORD, LETTERS = re.compile(r"\b[^\W\d_]+\b"), re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    """Words of letters; the letters of codes (next to digits) only where there
    is no other word."""
    text = text.lower()
    return WORD.findall(text) or LETTERS.findall(text)


def grams(words: list[str]):
    """(bucket, word number) of every n-gram, n = 1..4, of the marked words."""
    import numpy as np
    marked = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
    of = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    buckets, owners, h = [], [], np.zeros(len(marked), np.uint32)
    for n in range(1, 5):
        h = h[:len(marked) - n + 1] * np.uint32(0x01000193) + marked[n - 1:]
        whole = of[:len(of) - n + 1] == of[n - 1:]
        mixed = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
        buckets.append(((mixed ^ mixed >> np.uint32(15))[whole] % np.uint32(BUCKETS)).astype(np.int32))
        owners.append(of[:len(of) - n + 1][whole].astype(np.int32))
    return np.concatenate(buckets), np.concatenate(owners)


class Model:
    """Weights; emissions of distinct words are kept in a bounded memo."""

    def __init__(self, langs, lexicon, gram_weights, lexicon_weights, transitions):
        self.langs, self.lexicon, self.transitions = langs, lexicon, transitions
        self.gram_weights, self.lexicon_weights = gram_weights, lexicon_weights

    def emissions(self, words: list[str]):
        import numpy as np
        bucket, owner = grams(words)
        out = np.stack([np.bincount(owner, self.gram_weights[bucket, k], len(words))
                        for k in range(len(self.langs))], axis=1)
        known = np.array([self.lexicon.get(w, -1) for w in words])
        out[known >= 0] += self.lexicon_weights[known[known >= 0]]
        return out.astype(np.float32)


def unit(x):
    """``x`` scaled to sum 1 over its last axis."""
    return x / x.sum(axis=-1, keepdims=True)


def messages(emit, starts, transitions):
    """Forward and backward messages of every word, its scaled emissions and the
    transition factors. ``emit``: (words, labels) of all documents in a row;
    ``starts``: first word of each document and, at last, the end; no empty
    documents. Blocks of a document are joined by their transfer matrices."""
    import numpy as np
    labels = emit.shape[1]
    e = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float64)
    step = np.exp(transitions - transitions.max())
    sizes = np.diff(starts)
    blocks = -(-sizes // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    doc = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(doc)) - first_block[doc]
    begin = starts[doc] + nth * BLOCK
    length = np.minimum(BLOCK, starts[doc + 1] - begin)
    order = np.argsort(-length, kind="stable")      # blocks that still run stand in front
    active = [int((length > t).sum()) for t in range(BLOCK)]
    at = begin[order]

    transfer = np.broadcast_to(np.eye(labels), (len(doc), labels, labels)).copy()
    for t, n in enumerate(active):
        if n:
            x = (transfer[:n] @ step) * e[at[:n] + t][:, None, :]
            transfer[:n] = x / x.sum(axis=(1, 2), keepdims=True)
    by_block = np.empty_like(transfer)
    by_block[order] = transfer
    left = np.full((len(doc), labels), 1.0 / labels)      # message into each block from the left
    right = np.full((len(doc), labels), 1.0 / labels)     # and from the right
    most = int(blocks.max())
    for k in range(1, most):
        here = first_block[:-1][blocks > k] + k
        left[here] = unit((left[here - 1][:, None, :] @ by_block[here - 1])[:, 0])
    for k in range(2, most + 1):
        here = first_block[1:][blocks >= k] - k
        right[here] = unit((by_block[here + 1] @ right[here + 1][:, :, None])[:, :, 0])
    alpha, beta = np.empty_like(e), np.empty_like(e)
    message = left[order]
    for t, n in enumerate(active):
        if n:
            message[:n] = unit((message[:n] @ step) * e[at[:n] + t])
            alpha[at[:n] + t] = message[:n]
    message = right[order]
    for t in range(BLOCK - 1, -1, -1):
        n = active[t]
        if n:
            beta[at[:n] + t] = message[:n]
            message[:n] = unit((message[:n] * e[at[:n] + t]) @ step.T)
    return alpha, beta, e, step


def marginals(emit, starts, transitions):
    """Marginals of every word; arguments as of ``messages``."""
    alpha, beta, _, _ = messages(emit, starts, transitions)
    return unit(alpha * beta)


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS) -> Model | None:
    """``rows``: (text, label). Maximises the likelihood of the labels of mixed
    sequences by Adagrad on the CRF's gradient (observed less expected)."""
    import numpy as np
    rng = np.random.default_rng(7)
    by_lang: dict[str, list[list[str]]] = {}
    for text, lang in rows:
        words = words_of(text)
        cut = 0
        while cut < len(words):
            n = int(rng.geometric(1 / PIECE))
            by_lang.setdefault(lang, []).append(words[cut:cut + n])
            cut += n
    langs = sorted(by_lang)
    if not langs:
        return None
    pieces = [(k, p) for k, lang in enumerate(langs) for p in by_lang[lang]]
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    flat = [w for _, p in pieces for w in p]
    gold = np.repeat([k for k, _ in pieces], [len(p) for _, p in pieces])
    whole = max(len(flat) // SEQUENCE * SEQUENCE, min(len(flat), SEQUENCE))
    flat, gold = flat[:whole], gold[:whole]
    words = sorted(set(flat))
    number = {w: i for i, w in enumerate(words)}
    seen = np.array([number[w] for w in flat])
    # the lexicon: words seen more than once
    often = np.flatnonzero(np.bincount(seen) > 1)
    lexicon = {words[i]: k for k, i in enumerate(often)}
    slot = np.full(len(words), len(often))
    slot[often] = np.arange(len(often))
    model = Model(langs, lexicon, np.zeros((BUCKETS, len(langs))), np.zeros((len(often) + 1, len(langs))),
                  np.zeros((len(langs), len(langs))))
    bucket, owner = grams(words)
    starts = np.arange(0, len(flat) + 1, min(SEQUENCE, len(flat)))
    follows = np.ones(len(flat), bool)
    follows[starts[:-1]] = False
    sums = [np.full_like(x, 1e-6) for x in (model.gram_weights, model.lexicon_weights, model.transitions)]
    same = np.eye(len(langs))[gold]
    nxt = np.flatnonzero(follows)
    for _ in range(epochs):
        emit = np.stack([np.bincount(owner, model.gram_weights[bucket, k], len(words)) for k in range(len(langs))], 1)
        emit += model.lexicon_weights[slot]
        alpha, beta, e, step = messages(emit[seen], starts, model.transitions)
        post = unit(alpha * beta)
        pair = alpha[nxt - 1][:, :, None] * step * (e[nxt] * beta[nxt])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        wrong = same - post
        word = np.stack([np.bincount(seen, wrong[:, k], len(words)) for k in range(len(langs))], 1)
        steps = [np.stack([np.bincount(bucket, word[owner, k], BUCKETS) for k in range(len(langs))], 1),
                 np.stack([np.bincount(slot, word[:, k], len(often) + 1) for k in range(len(langs))], 1),
                 same[nxt - 1].T @ same[nxt] - pair.sum(axis=0)]
        for weights, total, step in zip((model.gram_weights, model.lexicon_weights, model.transitions), sums, steps):
            step = step / len(flat) - 1e-6 * weights
            total += step * step
            weights += 0.25 * step / np.sqrt(total)
    return model


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """A model from labelled rows of ``docs`` that are not held out."""
    rows = (docs.filter(F.col("lang").isNotNull() & ~held_out(docs["doc_id"]))
            .select(text_of(docs).alias("text"), F.col("lang").cast("string").alias("lang")).filter("text != ''")
            .select("lang", (F.length("text") > LONGEST).alias("cut"), F.substring("text", 1, LONGEST).alias("text"))
            .withColumn("h", F.xxhash64("text")))
    # the least hashes of each label first (8 bytes a text, copies once), then only their texts
    order = W.partitionBy("lang").orderBy("cut", "h")
    least = (rows.groupBy("lang", "h").agg(F.min("cut").alias("cut")).withColumn("nth", F.row_number().over(order))
             .filter(F.col("nth") <= per_lang).select("lang", "h"))
    some = rows.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    return train(sorted((r["text"], r["lang"]) for r in some))


class Labeller:
    """Emissions of distinct words, kept for one worker process."""

    def __init__(self, model: Model):
        self.model, self.rows, self.table = model, {}, None

    def ids(self, lists: list[list[str]]):
        import numpy as np
        if self.table is None or len(self.rows) > WORDS_KEPT:
            self.rows, self.table = {}, np.empty((0, len(self.model.langs)), np.float32)
        missing = list({w for ws in lists for w in ws if w not in self.rows})
        if missing:
            self.rows.update(zip(missing, range(len(self.table), len(self.table) + len(missing))))
            self.table = np.concatenate([self.table, self.model.emissions(missing)])
        rows = self.rows
        return np.fromiter((rows[w] for ws in lists for w in ws), np.int64)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, runs (of words with one label: lang, first word,
    number of words) of each row."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        labeller = Labeller(model) if model else None
        for part in slices(batches, text_sizes, SLICE_BYTES):
            lists = [words_of(t) if model else [] for t in part.column("text").to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            some = np.flatnonzero(sizes)
            pred, score = np.full(len(lists), UNKNOWN, object), np.zeros(len(lists))
            langs, firsts, counts, per_doc = [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(lists), np.int64)
            if len(some):
                starts = np.concatenate([[0], np.cumsum(sizes[some])])
                ids = labeller.ids(lists)
                post = marginals(labeller.table[ids], starts, model.transitions)
                total = np.add.reduceat(post, starts[:-1], axis=0)
                best = total.argmax(axis=1)
                names = np.array(model.langs, object)
                pred[some], score[some] = names[best], np.minimum(1.0, total[np.arange(len(some)), best] / sizes[some])
                label = post.argmax(axis=1)
                new = np.ones(len(label), bool)
                new[1:] = label[1:] != label[:-1]
                new[starts[:-1]] = True
                at = np.flatnonzero(new)
                owner = np.searchsorted(starts, at, side="right") - 1
                langs, firsts = names[label[at]], at - starts[owner]
                counts = np.diff(np.append(at, len(label)))
                per_doc[some] = np.bincount(owner, minlength=len(some))
            runs = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(firsts, pa.int32()), pa.array(counts, pa.int32())],
                                           ["lang", "first", "words"]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), runs],
                ["doc_id", "lang_pred", "score", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_batches(docs).select("doc_id", text_of(docs).alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, runs array<struct<lang:string,first:int,words:int>>")


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """The rows whose language is known with a score of at least ``least``."""
    def accepted(texts):
        import numpy as np
        import pandas as pd
        labeller, out, begin = Labeller(model), [], 0
        ends = np.cumsum(texts.str.len().to_numpy())
        while begin < len(texts):     # words of a few megabytes of text at a time
            before = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            lists = [words_of(t) for t in texts.iloc[begin:stop]]
            sizes = np.array([len(x) for x in lists], np.int64)
            ok, some = np.zeros(stop - begin, bool), np.flatnonzero(sizes)
            if len(some):
                starts = np.concatenate([[0], np.cumsum(sizes[some])])
                ids = labeller.ids(lists)
                post = marginals(labeller.table[ids], starts, model.transitions)
                ok[some] = np.add.reduceat(post, starts[:-1], axis=0).max(axis=1) >= least * sizes[some]
            out.append(ok)
            begin = stop
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    if model is None:
        return docs.limit(0)
    flag = fresh(docs, "accepted")
    return (text_batches(docs).withColumn(flag, F.pandas_udf(accepted, "boolean")(text_of(docs)))
            .filter(F.col(flag)).select(*docs.columns))

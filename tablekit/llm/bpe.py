"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last ``SPAN`` code points cuts every text into chunks at
places that depend only on the text around them, so documents that share a
passage share its chunks. A chunk is encoded once and kept in a bounded memo of
the worker process; other documents reuse its ids. Because a cut may fall inside
a word, the ids next to a cut are not trusted: the piece between the last white
space before the cut and the first white space after it is encoded again as one
(over as many chunks as have no white space), and there both sides agree
exactly, as no token of this vocabulary crosses white space.

Chunks are shared within a worker process, not by a shuffle: the ids of a text
take more bytes than the text, and moving both would cost more than encoding.

Defined results: a null or empty text has no ids and decodes to the empty text.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import slices, text_batches, text_of, text_sizes
from .units import BLANK, OTHER_BLANK, Memo, per_process

SPAN, MASK, CHUNKS_KEPT, SLICE_BYTES = 16, 511, 20_000, 1 << 20
BLANKS = re.compile(f"[{BLANK}]+")
PLAIN = re.compile("([A-Za-z]+)([.,]?)")


class ChunkedBpe:
    """Token ids of a word-level BPE (tokenizers file) for many texts at once."""

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # letters of lower case are a word of their own under this file's rules
        self.words = self.whole.model if {"type": "Lowercase"} in (spec["normalizer"] or {}).get("normalizers", []) else None
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.token = [""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.token[i] = token
        self.mark = {c: self.whole.encode(c, add_special_tokens=False).ids for c in ("", ".", ",")}
        self.units = Memo(self.encode_units)
        self.chunks: dict[str, tuple] = {}

    def encode_units(self, units: list[str]) -> list[bytes]:
        import array
        out: list = [None] * len(units)
        rest = []
        for k, u in enumerate(units):
            plain = PLAIN.fullmatch(u) if self.words is not None else None
            if plain:
                out[k] = [t.id for t in self.words.tokenize(plain[1].lower())] + self.mark[plain[2]]
            else:
                rest.append(k)
        for k, e in zip(rest, self.whole.encode_batch_fast([units[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return [array.array("i", x).tobytes() for x in out]

    @staticmethod
    def split(text: str) -> list[str]:
        if OTHER_BLANK.search(text):
            return [u for u in BLANKS.split(text) if u]
        return text.split()

    @staticmethod
    def cuts(texts: list[str]) -> list[list[int]]:
        """Of each text, the places where the rolling hash of the code points
        before them says to cut."""
        import numpy as np
        joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        h = np.zeros(len(joined) + 1, dtype=np.uint32)
        factor = 1
        for back in range(1, SPAN + 1):
            h[back:] += joined[:len(joined) + 1 - back] * np.uint32(factor)
            factor = factor * 0x01000193 & 0xFFFFFFFF
        at = np.flatnonzero((h * np.uint32(0x9E3779B1) >> np.uint32(20)) & np.uint32(MASK) == 0)
        ends = np.cumsum([0] + [len(t) for t in texts])
        first, last = np.searchsorted(at, ends[:-1] + SPAN), np.searchsorted(at, ends[1:])
        return [(at[i:j] - start).tolist() for i, j, start in zip(first, last, ends[:-1])]

    def learn(self, new: list[str]) -> None:
        """Encode chunks: (text before the first white space, ids, text after the
        last); a chunk without white space is (chunk, None, "")."""
        parts, middles = [], []
        for c in new:
            first = BLANKS.search(c)
            if not first:
                parts.append((c, None, ""))
                continue
            last = max(map(c.rfind, BLANK)) + 1
            parts.append((c[:first.start()], len(middles), c[last:]))
            middles.append(self.split(c[first.start():last]))
        memo = self.units.ready(u for m in middles for u in m)
        for c, (head, k, tail) in zip(new, parts):
            self.chunks[c] = (head, None if k is None else b"".join([memo[u] for u in middles[k]]), tail)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as native 32-bit integers."""
        pieces = []
        for t, at in zip(texts, self.cuts(texts)):
            bounds = [0, *at, len(t)]
            pieces.append([t[i:j] for i, j in zip(bounds, bounds[1:])])
        if len(self.chunks) > CHUNKS_KEPT:
            self.chunks = {}
        self.learn(list({c for p in pieces for c in p if c not in self.chunks}))
        # repair: what lies between the white space on both sides of a cut is encoded as one
        plans, joins = [], []
        for p in pieces:
            plan, open_ = [], ""
            for c in p:
                head, ids, tail = self.chunks[c]
                open_ += head
                if ids is not None:
                    plan.append((self.split(open_) if open_ else [], ids))
                    open_ = tail
            plan.append((self.split(open_) if open_ else [], b""))
            plans.append(plan)
            joins += [u for units, _ in plan for u in units]
        memo = self.units.ready(joins)
        return [b"".join([b"".join([memo[u] for u in units]) + ids for units, ids in plan]) for plan in plans]

    def decode(self, ids) -> str:
        """As the tokenizer does without a decoder: the tokens, spaced."""
        return " ".join(map(self.token.__getitem__, ids))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (text) of each row of ``docs``."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        bpe = per_process(ChunkedBpe, path)
        for part in slices(batches, text_sizes, SLICE_BYTES):
            ids = [np.frombuffer(x, dtype=np.int32) for x in bpe.encode(part.column("text").to_pylist())]
            offsets = pa.array(np.cumsum([0] + [len(x) for x in ids]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32())),
                 pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_batches(docs).select("doc_id", text_of(docs).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded string")

"""Encoding by units: a text is cut only where no token can cross (in front of
white space), each distinct unit is encoded once per worker process, and later
occurrences are looked up. The memo is bounded: two generations of ``most``
units; a full young one becomes the old one."""

from __future__ import annotations

import re


class Memo:
    """unit -> value, filled by ``encode(list of units) -> list of values``."""

    def __init__(self, encode, most: int = 100_000):
        self.encode, self.most, self.young, self.old = encode, most, {}, {}

    def ready(self, units) -> dict:
        """A dict that has every one of ``units``."""
        young, old = self.young, self.old
        missing = []
        for u in set(units).difference(young):
            if u in old:
                young[u] = old[u]
            else:
                missing.append(u)
        young.update(zip(missing, self.encode(missing)))
        if len(young) > self.most:
            self.old, self.young = young, {}
        return young


#: White space of which the tokenizers and Python agree; texts with any other
#: kind are encoded whole.
BLANK = " \t\n\r"
OTHER_BLANK = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Units of byte-level BPE: white space in front of what is none.
SPACED = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+$")


class ByteBpe:
    """Token ids of byte-level BPE as bytes (little-endian unsigned 32-bit).

    ``path`` is a tokenizers file; if ``ranks`` names the same vocabulary as
    ranks, units without a special token are merged by tiktoken, which gives the
    same ids faster.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        import array
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.packed = lambda ids: array.array("I", ids).tobytes()
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f)["added_tokens"]]
        self.fast = None
        if ranks:
            import base64

            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.memo = Memo(self.encode_units)

    def encode_units(self, units: list[str]) -> list[bytes]:
        def one(u):
            if self.fast is None or any(s in u for s in self.special):
                return self.whole.encode(u, add_special_tokens=False).ids
            return self.fast.encode_ordinary(u)
        return [self.packed(one(u)) for u in units]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [[t] if OTHER_BLANK.search(t) else SPACED.findall(t) for t in texts]
        memo = self.memo.ready(u for c in cut for u in c)
        return [b"".join([memo[u] for u in c]) for c in cut]


def per_process(kind, *args):
    """One ``kind(*args)`` per worker process, kept between its tasks."""
    import sys
    import types
    made = sys.modules.setdefault("_tablekit_worker", types.ModuleType("_tablekit_worker")).__dict__
    key = repr((kind.__name__, args))
    if key not in made:
        made[key] = kind(*args)
    return made[key]

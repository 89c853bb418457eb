"""Secrets in texts by a linear-chain conditional random field over tokens.

Three kinds are known by exact rules (``base_spans``): assign (a value given to a
name like ``password``), access (``AKIA...``) and hex (long runs of lower-case hex
digits). The model adds spans of kind ``secret`` that the rules miss; base spans
always stay. Tokens (runs of letters and digits, single signs) are tagged as
begin, inside or outside of a secret, by features of their shape, of the words
and signs around them and of the whole file, with learned transitions.

Every token of every text is read: a text is one chain, decoded by Viterbi; a
secret must beat the reading without it by ``MARGIN``. ``Reader`` computes the
emissions of a block of texts at once, then a bound on what a secret through each
token could gain; tokens where that is nothing are outside in the best reading, so
the best paths through the others give the best reading of the whole chain.

Training (likelihood by forward-backward over whole texts, a step per text) uses at
most ``SAMPLE`` different texts of at most ``LONGEST`` characters, ``LESSON`` together,
chosen by hash among those where ``LESSONS`` matches and labelled by the rules. Texts
are searched whole.

Defined results: a null or empty text has no spans; a table without lessons
trains nothing and adds nothing; rows are independent of each other, so repeated
rows get equal spans.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of, text_sizes

KINDS, ADDED = ("assign", "access", "hex"), "secret"
SAMPLE, LONGEST, LESSON, EPOCHS, MARGIN = 300, 1 << 18, 2 << 20, 8, 2.0
#: Bytes of texts, and characters, that are read at once; words kept by a reader.
SLICE_BYTES, BLOCK, WORDS = 1 << 19, 1 << 18, 100_000

# the set of first letters is what lets the search skip
ASSIGN = re.compile(r"""(?=[AaPpSsTt])(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
NAMES = re.compile(r"(?=[AaPpSsTt])(?:password|passwd|secret|token|api_?key)", re.I | re.A)
#: What belongs together without a blank; any other sign stands alone.
FIELDS = re.compile(r"[A-Za-z0-9+/_.=-]+|[^\sA-Za-z0-9+/_.=-]")
TOKENS = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
SPACE, SIGN = re.compile(r"\s"), re.compile(r"\S")
#: Texts that are worth learning from: with a base span or a long field with a digit.
LESSONS = (r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]|(?-i)AKIA[A-Z0-9]{14}|[0-9a-f]{16}|"""
           r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z0-9+/_.=-]{12})[A-Za-z+/_.=-]*[0-9]")
#: A text without any of these has no token: no base span and nothing to read.
CANDIDATE = r"[^\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
OUTSIDE, BEGIN, INSIDE = range(3)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by the exact rules, sorted by start, then kind."""
    return sorted(((a, b, k) for a, b, k, _ in _matches(text)), key=lambda s: (s[0], s[2], s[1]))


def _matches(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind number, start of the value)."""
    found = [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]


def chains(text: str) -> Iterator[list[tuple[int, int, int, int]]]:
    """The tokens of a text, all in one chain (none: no chain): (start, end, start
    and end of the field) of each token."""
    chain = [(t.start(), t.end(), m.start(), m.end()) for m in FIELDS.finditer(text)
             for t in TOKENS.finditer(text, m.start(), m.end())]
    if chain:
        yield chain


def file_features(text: str) -> list[str]:
    lines = text.count("\n") + 1
    settings = text.count("=") + text.count(":")
    return [f"file:settings={min(5, 4 * settings // lines)}", f"file:code={min(3, (text.count('{') + text.count(';')) // 4)}",
            f"file:names={NAMES.search(text) is not None}", f"file:long={min(6, len(text).bit_length() // 3)}"]


FORMS = str.maketrans({chr(c): "a" if chr(c).islower() else "A" if chr(c).isalpha() else "0" for c in range(128) if chr(c).isalnum()})
RUN, HEXES = re.compile(r"(.)\1+", re.S), re.compile("[0-9a-f]{8,}|[0-9A-F]{8,}")


def shape(token: str) -> str:
    return RUN.sub(r"\1", token.translate(FORMS))


#: How far the features look around: tokens, of them for signs; characters for names.
BEFORE, SIGNS, NAMED = 5, 3, 48


def own(token: str) -> tuple[str, ...]:
    """Features of a token alone."""
    size, forms = len(token), token.translate(FORMS)
    form = RUN.sub(r"\1", forms)
    return _own(form, size, 8 * forms.count("0") // size, 8 * len(set(token)) // size, HEXES.fullmatch(token) is not None,
                token[:4] if "a" not in form and "A" in form else "", token if size == 1 and form not in "aA0" else "")


@lru_cache(1 << 12)
def _own(form: str, size: int, digits: int, different: int, hexes: bool, head: str, sign: str) -> tuple[str, ...]:
    return ("bias", f"shape={form if len(form) < 6 else 'mixed'}", f"turns={min(8, len(form))}", f"n={min(40, size) // 4}",
            f"digits={digits}", f"different={different}", f"hex={hexes}", f"head={head}", f"sign={sign}")


def word_of(token: str) -> str:
    return token.lower() if token.isalpha() else "0"


def around(before: list[str], after: str, named: bool) -> list[str]:
    """Features of the words and signs next to a field."""
    words = [word_of(w) for w in before if w.isalnum() and w.isascii()]
    signs = "".join(w for w in before[-SIGNS:] if not (w.isalnum() and w.isascii()))
    return [f"word={words[-1] if words else ''}", f"second={words[-2] if len(words) > 1 else ''}", f"signs={signs}",
            f"given={':' in signs or '=' in signs}", f"named={named}", f"next={'w' if after.isalnum() and after.isascii() else after or 'w'}"]


def features(text: str, chain: list, of_file: list[str]) -> list[list[str]]:
    out, near, of, nth = [], [], {}, 0
    tokens = [text[start:end] for start, end, _, _ in chain]
    names = [m.span() for m in NAMES.finditer(text)]
    for t, (start, end, low, high) in enumerate(chain):
        if start == low:
            after = t + 1
            while after < len(chain) and chain[after][2] == low:
                after += 1
            while nth < len(names) and names[nth][1] <= low:
                nth += 1
            near = around(tokens[max(0, t - BEFORE):t], tokens[after] if after < len(chain) else "", nth > 0 and names[nth - 1][0] >= low - NAMED)
        token = tokens[t]
        if token not in of:
            of[token] = own(token)
        out.append([*of[token], f"field={min(64, high - low) // 8}", f"first={start == low}", f"last={end == high}",
                    *(f"{x}|first={start == low}" for x in near), *of_file])
    return out


NEVER = -math.inf
#: Transitions that cannot be: nothing goes on inside before it began.
START = [0.0, 0.0, NEVER]


def emissions(feats: list[list[str]], weights: dict) -> list[list[float]]:
    zero = (0.0, 0.0, 0.0)
    return [[sum(w) for w in zip(*(weights.get(f, zero) for f in fs))] for fs in feats]


def steps(weights: dict) -> list[list[float]]:
    out = [list(weights.get(("step", k), (0.0, 0.0, 0.0))) for k in range(3)]
    out[OUTSIDE][INSIDE] = NEVER
    return out


def marginals(emit, step):
    """Probabilities of the tags of each token and of each pair of neighbours."""
    emit, step = np.asarray(emit, float), np.asarray(step, float)
    here = np.maximum(np.exp(emit - emit.max(axis=1, keepdims=True)), 1e-300)
    move = np.exp(step - step.max())
    # tag 2 cannot follow tag 0
    (m00, m01, _), (m10, m11, m12), (m20, m21, m22) = move.tolist()
    rows = here.tolist()
    a, b, c = rows[0][0], rows[0][1], 0.0
    total = a + b
    a, b = a / total, b / total
    forward, sizes = [(a, b, c)], [1.0]
    for x, y, z in rows[1:]:
        a, b, c = (a * m00 + b * m10 + c * m20) * x, (a * m01 + b * m11 + c * m21) * y, (b * m12 + c * m22) * z
        total = a + b + c
        a, b, c = a / total, b / total, c / total
        forward.append((a, b, c))
        sizes.append(total)
    a = b = c = 1.0
    backward = [(a, b, c)]
    for t in range(len(rows) - 1, 0, -1):
        x, y, z = rows[t]
        x, y, z = x * a / sizes[t], y * b / sizes[t], z * c / sizes[t]
        a, b, c = m00 * x + m01 * y, m10 * x + m11 * y + m12 * z, m20 * x + m21 * y + m22 * z
        backward.append((a, b, c))
    forward, backward = np.array(forward), np.array(backward[::-1])
    two = forward[:-1, :, None] * move * (here[1:] * backward[1:] / np.array(sizes)[1:, None])[:, None, :]
    return forward * backward, two


def viterbi(emit: list[list[float]], step: list[list[float]], margin: float = 0.0, barred: tuple = ()) -> list[int]:
    """The best tags; every secret costs ``margin``; tokens in ``barred`` are outside."""
    barred = set(barred)

    def own(t):
        o, b, i = emit[t]
        return [o, NEVER, NEVER] if t in barred else [o, b - margin, i]

    best, back = [s + e for s, e in zip(START, own(0))], []
    for t in range(1, len(emit)):
        e, came, now = own(t), [], []
        for j in range(3):
            score, i = max((best[i] + step[i][j], -i) for i in range(3))
            came.append(-i)
            now.append(score + e[j])
        best, back = now, [*back, came] if not back else (back.append(came) or back)
    tag = max(range(3), key=lambda k: (best[k], -k))
    out = [tag]
    for came in reversed(back):
        tag = came[tag]
        out.append(tag)
    return out[::-1]


def labelled(chain: list, values: list[tuple[int, int]]) -> list[int]:
    """Tags of the tokens of a chain by the values (start, end) that the rules found,
    in their order."""
    out, nth = [], 0
    for start, end, _, _ in chain:
        while nth < len(values) and values[nth][1] <= start:
            nth += 1
        inside = values[nth] if nth < len(values) and values[nth][0] < end else None
        out.append(OUTSIDE if inside is None else INSIDE if out and out[-1] != OUTSIDE and start > inside[0] else BEGIN)
    return out


def merged(values: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(values):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def train(texts: list[str], epochs: int = EPOCHS, rate: float = 0.2) -> dict:
    """feature -> weight per tag, and the transitions under ("step", tag), by
    Adagrad steps on the likelihood of the tags that the rules give."""
    rows, at = [], {}
    for text in texts:
        values = merged([(v, b) for _, b, _, v in _matches(text)])
        of_file = file_features(text)
        for chain in chains(text):
            ids = np.array([[at.setdefault(f, len(at)) for f in fs] for fs in features(text, chain, of_file)], np.int32)
            rows.append((ids, *np.unique(ids, return_inverse=True), np.eye(3)[labelled(chain, values)]))
    if not rows:
        return {}
    weights, sums = np.zeros((len(at), 3)), np.full((len(at), 3), 1e-2)
    # secrets are rare: without this the first steps would make every word a sign of none
    seen = sum(gold.sum(axis=0) for *_, gold in rows) + 1
    weights[at["bias"]] = np.log(seen / seen.sum())
    step, step_sums = np.zeros((3, 3)), np.full((3, 3), 1e-2)
    step[OUTSIDE, INSIDE] = NEVER
    for _ in range(epochs):
        for ids, own_ids, place, gold in rows:
            one, two = marginals(weights[ids].sum(axis=1), step)
            width = ids.shape[1]
            change = np.stack([np.bincount(place.ravel(), np.repeat(g, width), len(own_ids)) for g in (gold - one).T], axis=1)
            change[np.abs(change) <= 1e-4] = 0
            sums[own_ids] += change ** 2
            weights[own_ids] += rate * change / np.sqrt(sums[own_ids])
            if len(gold) > 1:
                change = gold[:-1].T @ gold[1:] - two.sum(axis=0)
                step_sums += change ** 2
                step += rate * change / np.sqrt(step_sums)
    out = {f: w for f, w in zip(at, weights.tolist()) if any(w)}
    return out | {("step", k): [0.0 if k == OUTSIDE and j == INSIDE else v for j, v in enumerate(vs)] for k, vs in enumerate(step.tolist())}


def _kinds() -> np.ndarray:
    """0 blank, 1 letter or digit, 2 sign of a field, 3 other sign, by code point;
    the last one stands for all above."""
    out = np.array([0 if chr(i).isspace() else 3 for i in range(0x3002)], np.int8)
    for c in range(128):
        out[c] = 1 if chr(c).isalnum() else 2 if chr(c) in "+/_.=-" else out[c]
    return out


#: More than any code point; signs are code points plus one, zero is none.
SIGN_BASE = 0x110002


class _Found:
    """Vectors of known codes; all others have zero."""

    def __init__(self, known: dict[int, list[float]]):
        self.codes = np.array(sorted(known) or [-1], np.int64)
        self.vectors = np.array([known[c] for c in sorted(known)] or [[0.0] * 3])

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where((self.codes[at] == codes)[:, None], self.vectors[at], 0.0)


class Reader(dict):
    """The weights as tables, to read many texts at once; also token -> its row."""

    def __init__(self, weights: dict, margin: float = MARGIN):
        self.weights, self.margin, self.step, self.kinds = weights, margin, steps(weights), _kinds()
        near: dict = {}
        for key, w in weights.items():
            if isinstance(key, str) and "|first=" in key:
                rest, _, first = key.rpartition("|first=")
                name, _, value = rest.partition("=")
                near.setdefault((name, first == "True"), {})[value] = w
        values = {v for (name, _), known in near.items() if name in ("word", "second") for v in known} | {""}
        self.words = {v: i for i, v in enumerate(sorted(values), 1)}
        self.near = {}
        for first in (False, True):
            flag = lambda name: np.array([near.get((name, first), {}).get(v, [0.0] * 3) for v in ("False", "True")])
            coded = lambda name: _Found({self._code(v): w for v, w in near.get((name, first), {}).items()})
            word = lambda name: np.array([near.get((name, first), {}).get(v, [0.0] * 3) for v in (None, *self.words)])
            self.near[first] = (word("word"), word("second"), coded("signs"), flag("given"), flag("named"), coded("next"))
        table = lambda name, keys: np.array([weights.get(f"{name}={k}", [0.0] * 3) for k in keys])
        self.field, self.first, self.last = table("field", range(9)), table("first", (False, True)), table("last", (False, True))
        self._forget()

    @staticmethod
    def _code(signs: str) -> int:
        code = 0
        for c in signs if signs != "w" else "":
            code = code * SIGN_BASE + ord(c) + 1
        return code

    def _forget(self) -> None:
        self.clear()
        self.rows: dict = {}
        self.sums: dict = {}
        self.own, self.word = np.zeros((1024, 3)), np.zeros(1024, np.int64)

    def __missing__(self, token: str) -> int:
        forms = token.translate(FORMS)
        # tokens that differ in none of these have the same features
        key = (forms, len(set(token)), len(token) > 7 and HEXES.fullmatch(token) is not None, token[:4] if token.isupper() else "",
               self.words.get(word_of(token), 0))
        row = self.rows.get(key)
        if row is None:
            row = self.rows[key] = len(self.rows)
            if row == len(self.word):
                self.own, self.word = np.concatenate([self.own, np.zeros_like(self.own)]), np.concatenate([self.word, np.zeros_like(self.word)])
            feats = own(token)
            if feats not in self.sums:
                self.sums[feats] = self._sum(feats)
            self.own[row], self.word[row] = self.sums[feats], key[-1]
        self[token] = row
        return row

    def _sum(self, feats: Sequence[str]) -> list[float]:
        return [sum(w) for w in zip([0.0] * 3, *(self.weights[f] for f in feats if f in self.weights))]

    def _block(self, text: str, heads: np.ndarray, files: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and emissions of the tokens; texts begin at ``heads``."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[np.minimum(points, len(self.kinds) - 1)]
        letter, fielded = kind == 1, (kind == 1) | (kind == 2)
        begin, begins_field = kind > 0, kind > 0
        begin[1:] &= ~(letter[1:] & letter[:-1])
        begins_field[1:] &= ~(fielded[1:] & fielded[:-1])
        start = np.flatnonzero(begin)
        n, is_word, first = len(start), letter[start], begins_field[start]
        end = start + 1
        end[is_word] = np.flatnonzero(letter & ~np.append(letter[1:], False)) + 1
        if len(self) > WORDS:
            self._forget()
        row = np.fromiter(map(self.__getitem__, TOKENS.findall(text)), np.int64, n)
        sign = np.where(is_word, 0, points[start].astype(np.int64) + 1)
        at = np.flatnonzero(first)                     # first token of each field
        field, after = np.cumsum(first) - 1, np.append(at[1:], n)
        low, size = start[at], end[after - 1] - start[at]
        doc = np.maximum(np.searchsorted(heads, low, "right") - 1, 0)
        head_tokens = np.searchsorted(start, heads)
        head, beyond = head_tokens[doc], np.append(head_tokens[1:], n)[doc]
        # the word before each token, then the two before each field
        words = np.append(-1, np.maximum.accumulate(np.where(is_word, np.arange(n), -1)))
        least, none = np.maximum(at - BEFORE, head), self.words[""]
        one = words[at]
        two = words[np.maximum(one, 0)]
        two = np.where((one >= least) & (two >= least), self.word[row[two]], none)
        one = np.where(one >= least, self.word[row[one]], none)
        signs, given = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        for k in range(SIGNS, 0, -1):
            s = np.where(at - k >= head, sign[np.maximum(at - k, 0)], 0)
            signs = np.where(s > 0, signs * SIGN_BASE + s, signs)
            given |= (s == ord(":") + 1) | (s == ord("=") + 1)
        names = np.array([m.span() for m in NAMES.finditer(text)], np.int64).reshape(-1, 2)
        name = np.append(-1 - NAMED, names[:, 0])[np.searchsorted(names[:, 1], low, "right")]
        named = name >= np.maximum(low - NAMED, heads[doc])
        follows = np.where(after < beyond, sign[np.minimum(after, n - 1)], 0)

        def near(is_first: bool, of: np.ndarray) -> np.ndarray:
            by_word, by_second, by_signs, by_given, by_named, by_next = self.near[is_first]
            return (by_word[one[of]] + by_second[two[of]] + by_signs(signs[of]) + by_given[given[of].astype(int)]
                    + by_named[named[of].astype(int)] + by_next(follows[of]))

        last = np.zeros(n, np.int64)
        last[after - 1] = 1
        emit = self.own[row] + (self.field[np.minimum(size, 64) // 8] + files[doc])[field] + self.first[first.astype(int)] + self.last[last]
        emit[at] += near(True, np.arange(len(at)))
        rest = np.flatnonzero(~first)
        emit[rest] += near(False, field[rest])
        return start, end, emit

    def emissions(self, text: str, heads: np.ndarray, files: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_block`` of the whole text, a block at a time with what lies around it."""
        out, low, left = [], 0, 0
        while low < len(text):
            cut = SPACE.search(text, low + BLOCK)
            high = cut.start() if cut else len(text)
            after = SIGN.search(text, high)
            part = text[left:after.start() + 1 if after else high]
            if SIGN.search(part):
                start, end, emit = self._block(part, heads - left, files)
                inner = slice(*np.searchsorted(start, (low - left, high - left)))
                out.append((start[inner] + left, end[inner] + left, emit[inner]))
                seen = start[:inner.stop] + left
                left = min(high - NAMED - 12, int(seen[-BEFORE:][0]) if len(seen) else left)
            low, left = high, max(left, 0)
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros((0, 3)))

    def worth(self, emit: np.ndarray, barred: np.ndarray) -> np.ndarray:
        """Indexes of the tokens that can be in a secret of the best reading: some run
        of tokens through them gains, each token and step counted at its most."""
        plain = self.step[OUTSIDE][OUTSIDE]
        inner = max(self.step[i][j] for i in (BEGIN, INSIDE) for j in (BEGIN, INSIDE)) - plain
        gain = np.maximum(emit[:, BEGIN] - self.margin, emit[:, INSIDE]) - emit[:, OUTSIDE] + inner
        gain[barred] = -1e6
        ends = max(0.0, self.step[OUTSIDE][BEGIN] - plain) - inner + max(0.0, *(self.step[k][OUTSIDE] - plain for k in (BEGIN, INSIDE)))
        total = np.append(0.0, np.cumsum(gain))
        most = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
        return np.flatnonzero(most + ends > -1e-3)

    def spans(self, texts: list[str], bases: list[list]) -> list[list[tuple[int, int]]]:
        """Of each text, the secrets of its best reading that touch no base span."""
        out: list[list] = [[] for _ in texts]
        heads = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        if not self.weights or not texts:
            return out
        start, end, emit = self.emissions("\n".join(texts), heads, np.array([self._sum(file_features(t)) for t in texts]))
        barred = np.zeros(len(start), bool)
        for head, base in zip(heads.tolist(), bases):
            for a, b in merged([(a, b) for a, b, _ in base]):
                barred[np.searchsorted(end, head + a, "right"):np.searchsorted(start, head + b)] = True
        worth = self.worth(emit, barred)
        if not len(worth):
            return out
        doc = np.searchsorted(heads, start[worth], "right") - 1
        limits = np.append(np.searchsorted(start, heads), len(start))
        cuts = np.flatnonzero((np.diff(worth) > 1) | (np.diff(doc) > 0)) + 1
        for a, z in zip([0, *cuts], [*cuts, len(worth)]):
            # the tokens beside a run are outside
            d, low, high = int(doc[a]), int(worth[a]), int(worth[z - 1]) + 1
            left, right = max(low - 1, int(limits[d])), min(high + 1, int(limits[d + 1]))
            closed = [t - left for t in range(left, right) if barred[t] or not low <= t < high]
            tags = viterbi(emit[left:right].tolist(), self.step, self.margin, closed)
            for t, tag in enumerate(tags, left):
                if tag == BEGIN:
                    out[d].append((int(start[t] - heads[d]), int(end[t] - heads[d])))
                elif tag == INSIDE:
                    out[d][-1] = (out[d][-1][0], int(end[t] - heads[d]))
        return out


def added_spans(text: str, base: list, weights: dict, margin: float = MARGIN) -> list[tuple[int, int]]:
    """Secrets of the best reading of a text that touch no base span."""
    return Reader(weights, margin).spans([text], [base])[0]


def is_candidate(text: Column) -> Column:
    return text.rlike(CANDIDATE)


def least_lessons(rows: DataFrame, most: int) -> list[int]:
    """The ``most`` smallest different hashes in column ``h`` of texts to learn from
    (fewer, if there are not so many). Only texts whose hash is under a bound are
    looked at; should too few of them be lessons, it is raised."""
    share = min(1.0, 64 * most / max(1, rows.count()))
    while True:
        bound = -(1 << 63) + min((1 << 64) - 1, int(share * (1 << 64)))
        few = rows.filter((F.col("h") <= bound) & (F.length("text") <= LONGEST) & F.col("text").rlike(LESSONS))
        least = [r["h"] for r in few.select("h").distinct().orderBy("h").limit(most).collect()]
        if len(least) == most or share == 1:
            return least
        share = min(1.0, 8 * share)


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Weights from at most ``sample`` different texts of ``LESSON`` characters together."""
    rows = docs.select(text_of(docs).alias("text")).withColumn("h", F.xxhash64("text"))
    least = least_lessons(rows, sample)
    some = rows.filter(F.col("h").isin(least)).groupBy("h").agg(F.min("text").alias("text"))
    texts, size = [], 0
    for r in some.orderBy("h").collect():
        size += len(r["text"])
        texts += [r["text"]] if size <= LESSON else []
    return train(texts)


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_secrets(docs: DataFrame, weights: dict) -> DataFrame:
    """doc_id, spans (kind, start, end in code points, base) of each row."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        reader = Reader(weights)
        for part in slices(batches, text_sizes, SLICE_BYTES):
            out = []
            texts = [text or "" for text in part.column("text").to_pylist()]
            bases = [base_spans(text) for text in texts]
            for base, added in zip(bases, reader.spans(texts, bases)):
                both = [(a, k, b, True) for a, b, k in base] + [(a, len(KINDS), b, False) for a, b in added]
                out.append([{"kind": (*KINDS, ADDED)[k], "start": a, "end": b, "base": own} for a, k, b, own in sorted(both)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_of(docs)
    # texts without a token stay in the JVM
    return (docs.select("doc_id", F.when(is_candidate(text), text).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, spans {SPANS}"))

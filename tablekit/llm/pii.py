"""Personal data by a semi-Markov conditional random field over candidate spans.

Four kinds are known by exact rules (``base_spans``): email, ip, card, phone.
The model adds spans that the rules miss; base spans always stay. Only regions
of words with a digit or ``@`` can hold an entity. A region is cut into atoms
(digit runs, letter runs, single signs); every run of at most ``ATOMS`` atoms is
a candidate segment, scored by features of the whole span (digit groups,
separators, checksum, neighbours). A dynamic programme over the atoms, with
bounded entity length, chooses boundaries and kinds together; a span is added
where it beats the best reading without it by ``MARGIN``.

Training (conditional log-likelihood by forward-backward over the same lattice)
uses at most ``SAMPLE`` documents of the table, labelled by the rules. Texts are
searched whole.

Defined results: a null or empty text has no spans; a table without candidates
trains nothing and adds nothing; rows are independent of each other, so repeated
rows get equal spans.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, least_hashes, slices, text_batches, text_of, text_sizes

KINDS = ("email", "ip", "card", "phone")
ATOMS, CHARS, SAMPLE, EPOCHS, MARGIN, SLICE_BYTES = 24, 64, 300, 8, 2.0, 4 << 20
#: Longest document, and most atoms of a region, of the training sample (all texts
#: are searched whole).
LONGEST, TRAINED_ATOMS = 1 << 18, 400

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, so starts there need no trial
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SEED = re.compile(r"[0-9@]")
WORD = re.compile(r"\S*")
ATOM = re.compile(r"[0-9]+|[A-Za-z]+|\S")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
            at = text.find("@", end)
        else:
            # nothing up to here can start a later match: the sign is in no name
            end, at = max(end, at + 1), text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by the exact rules, sorted by start, then kind."""
    found = [(a, b, 0) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of words, one blank apart, that all have a digit or ``@``."""
    low, seed = 0, SEED.search(text)
    while seed:
        start = max(low, *(text.rfind(c, low, seed.start()) + 1 for c in " \n\t\r"))
        end = WORD.match(text, seed.end()).end()
        while end + 1 < len(text):
            after = WORD.match(text, end + 1).end()
            if after == end + 1 or not SEED.search(text, end + 1, after):
                break
            end = after
        yield start, end
        low, seed = end, SEED.search(text, end)


def features(text: str, start: int, end: int) -> list[str]:
    span = text[start:end]
    runs = re.findall("[0-9]+", span)
    digits = "".join(runs)
    shape = re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", re.sub("[0-9]+", "0", span)))
    left, right = text[start - 1:start], text[end:end + 1]
    out = ["bias", f"shape={shape[:24]}", f"n={min(len(digits), 20)}", f"groups={len(runs)}",
           f"widths={'-'.join(str(min(len(r), 9)) for r in runs[:6])}", f"first={shape[0]}", f"at={min(span.count('@'), 2)}",
           f"dots={min(span.count('.'), 5)}", f"left={'w' if left.isalnum() else left.strip() or ' '}",
           f"right={'w' if right.isalnum() else right.strip() or ' '}", f"end={shape[-1]}"]
    if 14 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if len(runs) == 4:
        out.append(f"octets={all(len(r) <= 3 and int(r) <= 255 for r in runs)}")
    return out


def lattice(text: str, start: int, end: int) -> tuple[int, list]:
    """Atoms of a region and its candidate segments: (first atom, atom behind
    the last, start, end) of spans that could be an entity at all."""
    atoms = [(m.start(), m.end()) for m in ATOM.finditer(text, start, end)]
    if sum(text.count(d, start, end) for d in "0123456789") < 7 and text.find("@", start, end) < 0:
        return len(atoms), []
    digits, ats = [0], [0]
    for a, b in atoms:
        digits.append(digits[-1] + (b - a if text[a] in "0123456789" else 0))
        ats.append(ats[-1] + (text[a] == "@"))
    out = []
    for i, (a, _) in enumerate(atoms):
        if not (text[a].isascii() and text[a].isalnum() or text[a] in "+("):
            continue
        for j in range(i + 1, min(i + ATOMS, len(atoms)) + 1):
            b = atoms[j - 1][1]
            if b - a > CHARS:
                break
            n, at = digits[j] - digits[i], ats[j] - ats[i]
            if at > 1 or at == 0 and n > 19:
                break
            if (at or n >= 7) and text[b - 1].isascii() and text[b - 1].isalnum():
                out.append((i, j, a, b))
    return len(atoms), out


def _sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def scored(text: str, segments: list, weights: dict) -> list[list[float]]:
    zero = [0.0] * len(KINDS)
    return [[sum(w) for w in zip(zero, *(weights.get(f, zero) for f in features(text, a, b)))] for _, _, a, b in segments]


def train(texts: list[str], epochs: int = EPOCHS, rate: float = 0.3) -> dict:
    """feature -> weight per kind, by gradient steps on the likelihood of the
    base spans among all segmentations of their regions."""
    rows = []
    for text in texts:
        base = base_spans(text)
        for start, end in regions(text):
            n, segments = lattice(text, start, end)
            if segments and n <= TRAINED_ATOMS:
                gold, behind = set(), 0
                for a, b, k in base:
                    if start <= a and b <= end and a >= behind:
                        gold.add((a, b, k))
                        behind = b
                rows.append((text, n, segments, [features(text, a, b) for _, _, a, b in segments], gold))
    weights: dict = {}
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for text, n, segments, feats, gold in rows:
            score = scored(text, segments, weights)
            into, out_of = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
            for s, (i, j, _, _) in enumerate(segments):
                into[j].append(s)
                out_of[i].append(s)
            forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):   # an atom outside every entity scores 0
                forward[j] = _sum([forward[j - 1]] + [forward[segments[s][0]] + x for s in into[j] for x in score[s]])
            for i in range(n - 1, -1, -1):
                backward[i] = _sum([backward[i + 1]] + [backward[segments[s][1]] + x for s in out_of[i] for x in score[s]])
            for s, (i, j, a, b) in enumerate(segments):
                for k in range(len(KINDS)):
                    wrong = ((a, b, k) in gold) - math.exp(min(0.0, forward[i] + score[s][k] + backward[j] - forward[n]))
                    if abs(wrong) > 1e-3:
                        for f in feats[s]:
                            weights.setdefault(f, [0.0] * len(KINDS))[k] += step * wrong
    return weights


def added_spans(text: str, base: list, weights: dict, margin: float = MARGIN) -> list[tuple[int, int, int]]:
    """Spans of the best segmentation of each region that touch no base span."""
    out, nth = [], 0
    for start, end in regions(text):
        while nth < len(base) and base[nth][1] <= start:
            nth += 1
        n, segments = lattice(text, start, end)
        near = []
        for x in base[nth:]:
            if x[0] >= end:
                break
            near.append(x)
        segments = [s for s in segments if all(s[3] <= a or s[2] >= b for a, b, _ in near)]
        if not segments:
            continue
        into: list = [[] for _ in range(n + 1)]
        for s, kinds in zip(segments, scored(text, segments, weights)):
            best = max(kinds)
            if best > margin:
                into[s[1]].append((s, best - margin, kinds.index(best)))
        total, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            total[j] = total[j - 1]
            for s, score, kind in into[j]:
                if total[s[0]] + score > total[j]:
                    total[j], back[j] = total[s[0]] + score, (s, kind)
        j = n
        while j:
            if back[j] is None:
                j -= 1
            else:
                s, kind = back[j]
                out.append((s[2], s[3], kind))
                j = s[0]
    return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Weights from at most ``sample`` documents with candidates, of at most
    ``LONGEST`` characters each, chosen by hash."""
    rows = docs.select(text_of(docs).alias("text")).withColumn("h", F.xxhash64("text"))
    able = F.col("text").rlike("@|[0-9][0-9().-]+[0-9]") & (F.length("text") <= LONGEST)
    # the least hashes first (8 bytes each), then only their texts
    some = rows.filter(F.col("h").isin(least_hashes(rows.filter(able), sample))).groupBy("h").agg(F.min("text").alias("text"))
    return train([r["text"] for r in some.orderBy("h").collect()])


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_spans(docs: DataFrame, weights: dict) -> DataFrame:
    """doc_id, spans (kind, start, end in code points, base) of each row."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for part in slices(batches, text_sizes, SLICE_BYTES):
            out = []
            for text in part.column("text").to_pylist():
                base = base_spans(text)
                both = [(*s, True) for s in base] + [(*s, False) for s in added_spans(text, base, weights)]
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": own}
                            for a, b, k, own in sorted(both, key=lambda s: (s[0], s[2], s[1]))])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_batches(docs).select("doc_id", text_of(docs).alias("text")).mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def masked(docs: DataFrame, weights: dict) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets
    (overlapping spans by the first one's) and ``n_chars``, if there, counted
    anew; a null text stays null."""
    def mask(texts):
        def one(text):
            while text is not None:
                base, out, at = base_spans(text), [], 0
                for a, b, k in sorted(base + added_spans(text, base, weights)):
                    if a >= at:
                        out += [text[at:a], f"[{KINDS[k].upper()}]"]
                    at = max(at, b)
                if not out:   # digits that stood next to a span can be one without it
                    return text
                text = "".join(out) + text[at:]
            return None
        return texts.map(one, na_action="ignore")

    text, own = fresh(docs, "masked"), F.col("text").cast("string")
    # every kind has a digit or an @: other texts stay as they are and stay in the JVM
    found = F.pandas_udf(mask, "string")(F.when(own.rlike("[0-9@]"), own))
    out = text_batches(docs).withColumn(text, F.coalesce(found, own))
    changed = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changed).select(*docs.columns)

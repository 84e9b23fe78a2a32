"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns (`base_spans`) find emails, IP addresses, card and phone numbers.  The field then labels the tokens that could be such a thing at
all, those with an ASCII digit or an at-sign; every other token is known to be none, which cuts the chain exactly there.  Potentials:

* a log-linear unary one over the token's make-up (digits, dots, dashes, signs, letters),
* one between neighbouring tokens,
* a skip one between each occurrence of a token and the next one alike in the document (its letters and digits are the same).

All are estimated from counts over the whole corpus with the patterns' labels (one pass, summed in tasks).  Loopy message passing in
log space gives each token's marginals; runs of neighbours that agree on a kind with `sure` probability become added spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.text import Fingerprint, batches, small_batches, text_bytes, text_udf, word_spans

# The kinds in order and their patterns.
KINDS = ["email", "ip", "card", "phone"]
# email: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and ip: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), found in parts so that no text is read twice
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")

LABELS = 1 + len(KINDS)
DIGIT = np.zeros(256, dtype=bool)
DIGIT[0x30:0x3A] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
NUMBERS = DIGIT.copy()
NUMBERS[[ord(c) for c in " ().+-"]] = True
CORE = DIGIT | LETTER
LOCAL = CORE.copy()
LOCAL[[ord(c) for c in "._%+-"]] = True
FOLD = np.zeros(256, dtype=np.uint8)
FOLD[CORE] = np.arange(256, dtype=np.uint8)[CORE] | 0x20
TWINS = Fingerprint(31)


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: bytes) -> bytes:
    return bytes(c for c in text if 48 <= c <= 57)


def _emails(data: bytes, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """From each at-sign outwards: the longest name before it that no earlier match has, and the domain behind it."""
    signs = np.flatnonzero(raw == 0x40)
    if not len(signs):
        return
    word = np.searchsorted(starts, signs, side="right") - 1
    other = np.flatnonzero(~LOCAL[raw])  # an at-sign is one of them
    nearest = np.searchsorted(other, signs) - 1
    name_from = np.where(nearest >= 0, other[nearest] + 1, 0)
    done = 0
    for at, low, high in zip(signs.tolist(), np.maximum(name_from, starts[word]).tolist(), ends[word].tolist()):
        low = max(low, done)
        m = DOMAIN.match(data, at + 1, high) if low < at else None
        if m:
            done = m.end()
            yield low, done


def _addresses(data: bytes, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Four parts after four parts of each chain of numbers with dots between them, if none is over 255."""
    for chain in DOTTED.finditer(data, start, end):
        parts, at = chain.group().split(b"."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(raw: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of the batch, ordered.  A match of a pattern never leaves a run of the characters it is made of, so
    the patterns run on such stretches only: words with an at-sign, words with a digit and a dot, runs of digits and signs.  The time
    taken grows with the length of a word or run, not with its square."""
    if not len(raw):
        return []
    data = raw.tobytes()
    sums = {n: np.concatenate(([0], np.cumsum(mask))) for n, mask in (("dot", raw == 0x2E), ("digit", DIGIT[raw]))}
    inside = {n: s[ends] - s[starts] for n, s in sums.items()}
    found = [(a, b, 0) for a, b in _emails(data, raw, starts, ends)]
    for w in np.flatnonzero((inside["dot"] > 2) & (inside["digit"] > 3)):
        found += [(a, b, 1) for a, b in _addresses(data, int(starts[w]), int(ends[w]))]
    mask = NUMBERS[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    first = np.flatnonzero(mask & (np.concatenate(([True], ~mask[:-1])) | edge[:-1]))
    last = np.flatnonzero(mask & (np.concatenate((~mask[1:], [True])) | edge[1:])) + 1
    for r in np.flatnonzero(sums["digit"][last] - sums["digit"][first] >= 9):
        a, b = int(first[r]), int(last[r])
        for m in CARD.finditer(data, a, b):
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        for m in PHONE.finditer(data, a, b):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted((a, k, b) for a, b, k in found)


def _bucket(n: np.ndarray, edges: tuple[int, ...]) -> np.ndarray:
    return np.searchsorted(np.array(edges), n, side="right")


#: Of each feature: how many values it has.
SHAPE = {"at": 3, "plus": 2, "letters": 2, "digits": 8, "dots": 5, "dashes": 3, "parens": 2, "other": 2}


class Tokens:
    """Candidate tokens of a batch: their bytes, make-up (one number) and the edges between them."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        n = len(raw)

        def inside(mask: np.ndarray) -> np.ndarray:
            s = np.concatenate(([0], np.cumsum(mask)))
            return s[self.end] - s[self.start]

        wanted = DIGIT[raw] | (raw == 0x40) if n else np.zeros(0, dtype=bool)
        s = np.concatenate(([0], np.cumsum(wanted)))
        word = np.flatnonzero(s[ends] - s[starts] > 0)
        self.start, self.end, self.word = starts[word], ends[word], word
        self.doc = np.searchsorted(first, word, side="right") - 1
        digits = inside(DIGIT[raw])
        parts = {
            "at": np.minimum(inside(raw == 0x40), 2), "plus": inside(raw == 0x2B) > 0, "letters": inside(LETTER[raw]) > 0,
            "digits": _bucket(digits, (1, 4, 7, 9, 12, 16, 20)), "dots": np.minimum(inside(raw == 0x2E), 4),
            "dashes": np.minimum(inside(raw == 0x2D), 2), "parens": inside((raw == 0x28) | (raw == 0x29)) > 0, "other": inside(raw >= 0x80) > 0,
        }
        self.shape = np.zeros(len(word), dtype=np.int64)
        for name, values in parts.items():
            self.shape = self.shape * SHAPE[name] + parts[name].astype(np.int64)
        near = np.flatnonzero((self.word[1:] == self.word[:-1] + 1) & (self.doc[1:] == self.doc[:-1]))
        self.near = np.column_stack((near, near + 1))
        # tokens alike: the same letters and digits, in the same document
        core = CORE[raw] if n else np.zeros(0, dtype=bool)
        count = np.concatenate(([0], np.cumsum(core)))
        sums = TWINS.over(FOLD[raw[core]] if n else raw)
        key = TWINS.of(sums, count[self.start], count[self.end])
        long = np.flatnonzero(count[self.end] - count[self.start] >= 7)
        order = long[np.lexsort((long, key[long], self.doc[long]))]
        alike = (key[order][1:] == key[order][:-1]) & (self.doc[order][1:] == self.doc[order][:-1])
        self.skip = np.column_stack((order[:-1][alike], order[1:][alike]))

    def labels(self, spans: list[tuple[int, int, int]]) -> np.ndarray:
        """0 for none, else 1 + the kind of the first pattern match that the token touches."""
        out = np.zeros(len(self.start), dtype=np.int64)
        for a, k, b in reversed(spans):
            lo, hi = np.searchsorted(self.end, a, side="right"), np.searchsorted(self.start, b, side="left")
            out[lo:hi] = 1 + k
        return out


def _shape_features(shape: np.ndarray) -> np.ndarray:
    """One column for each value of each feature of a make-up number."""
    columns, rest = [], shape.copy()
    for name in reversed(SHAPE):
        value, rest = rest % SHAPE[name], rest // SHAPE[name]
        columns.append(np.eye(SHAPE[name])[value])
        if name in ("digits",):
            columns.append(columns[-1] * (rest % 2 == 0)[:, None])  # digits without letters
    return np.column_stack(columns)


class Field:
    """The potentials, from summed counts: {(what, code): n}."""

    def __init__(self, counts: dict[tuple[str, int], int]):
        shapes = sorted({code // LABELS for what, code in counts if what == "shape"})
        self.weights = None
        if shapes:
            x = _shape_features(np.array(shapes))
            y = np.zeros((len(shapes), LABELS))
            for (what, code), n in counts.items():
                if what == "shape":
                    y[shapes.index(code // LABELS), code % LABELS] += n
            n = y.sum(axis=1, keepdims=True)
            scale = np.sqrt(n)  # frequent make-ups count more, but do not drown the others
            w, z = np.zeros((x.shape[1], LABELS)), np.zeros((x.shape[1], LABELS))
            step = 4.0 / max((scale * (x**2).sum(axis=1, keepdims=True)).sum(), 1e-9)
            for k in range(3000):
                p = x @ z
                p = np.exp(p - p.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                later = z - step * (x.T @ (scale * (p - y / n)) + 1e-3 * z)
                z = later + k / (k + 3.0) * (later - w)
                w = later
            self.weights = w
        self.near = self._pairs(counts, "near")
        self.skip = self._pairs(counts, "skip", prior=np.eye(LABELS) * 20)

    @staticmethod
    def _pairs(counts: dict, name: str, prior: np.ndarray | float = 0.0) -> np.ndarray:
        """How much likelier two labels are together than apart, with a smoothing count."""
        c = np.full((LABELS, LABELS), 1.0) + prior
        for (what, code), n in counts.items():
            if what == name:
                c[code // LABELS, code % LABELS] += n
        if name == "skip":
            c = c + c.T
        return np.clip(np.log(c * c.sum() / (c.sum(axis=1, keepdims=True) * c.sum(axis=0, keepdims=True))), -4, 4)

    def marginals(self, tokens: Tokens, fixed: np.ndarray, rounds: int = 8) -> np.ndarray:
        """Probabilities (token, label) by damped loopy message passing; tokens with a base label keep it."""
        n = len(tokens.start)
        unary = np.zeros((n, LABELS))
        if not n or self.weights is None:
            unary[:, 0] = 1.0
            return unary
        unary = np.clip(_shape_features(tokens.shape) @ self.weights, -30, 30)
        unary[fixed > 0] = -30.0
        unary[np.flatnonzero(fixed), fixed[fixed > 0]] = 30.0
        unary -= unary.max(axis=1, keepdims=True)
        edges = [(e[:, a], e[:, b], pot if a == 0 else pot.T) for e, pot in ((tokens.near, self.near), (tokens.skip, self.skip)) for a, b in ((0, 1), (1, 0))]
        messages = [np.zeros((len(a), LABELS)) for a, _, _ in edges]
        belief = unary
        for _ in range(rounds):
            later = []
            for k, (a, _, pot) in enumerate(edges):
                given = belief[a] - messages[k ^ 1]  # without what came along this edge
                m = np.logaddexp.reduce(given[:, :, None] + pot[None], axis=1)
                m -= m.max(axis=1, keepdims=True)
                later.append(0.5 * messages[k] + 0.5 * m)
            messages = later
            belief = unary.copy()
            for (_, b, _), m in zip(edges, messages, strict=True):
                np.add.at(belief, b, m)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _added(tokens: Tokens, p: np.ndarray, fixed: np.ndarray, raw: np.ndarray, base: list[tuple[int, int, int]], sure: float) -> list[tuple[int, int, int]]:
    """Runs of neighbouring tokens with one sure kind, trimmed to their first and last letter, digit or plus, that no base span touches."""
    best = np.argmax(p, axis=1)
    good = (best > 0) & (p[np.arange(len(best)), best] >= sure) & (fixed == 0) if len(best) else np.zeros(0, dtype=bool)
    out, run = [], []
    taken = [(a, b) for a, _, b in base]
    for t in [*np.flatnonzero(good), None]:
        if run and (t is None or t != run[-1] + 1 or best[t] != best[run[-1]] or tokens.word[t] != tokens.word[run[-1]] + 1 or tokens.doc[t] != tokens.doc[run[-1]]):
            a, b = int(tokens.start[run[0]]), int(tokens.end[run[-1]])
            while a < b and not (CORE[raw[a]] or raw[a] == 0x2B):
                a += 1
            while b > a and not CORE[raw[b - 1]]:
                b -= 1
            if a < b and not any(x < b and a < y for x, y in taken):
                out.append((a, int(best[run[0]]) - 1, b))
            run = []
        if t is not None:
            run.append(t)
    return out


def batch_spans(raw: np.ndarray, at: np.ndarray, field: Field | None, sure: float) -> list[list[tuple[int, int, int, bool]]]:
    """For each text its spans (start, end, kind, base) in code points, ordered by start, then kind."""
    starts, ends, first = word_spans(raw, at)
    base = base_spans(raw, at, starts, ends)
    spans = [(*s, True) for s in base]
    if field is not None:
        tokens = Tokens(raw, at, starts, ends, first)
        fixed = tokens.labels(base)
        spans += [(*s, False) for s in _added(tokens, field.marginals(tokens, fixed), fixed, raw, base, sure)]
    char = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    out: list[list] = [[] for _ in range(len(at) - 1)]
    for a, k, b, is_base in sorted(spans):
        d = int(np.searchsorted(at, a, side="right")) - 1
        out[d].append((int(char[a] - char[at[d]]), int(char[b] - char[at[d]]), k, is_base))
    return out


def fit(docs: DataFrame, text: str = "text") -> Field:
    """The potentials from all documents: at most a few thousand sums reach the driver, whatever the size."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], int] = {}
        for batch in batches(stream):
            raw, at = text_bytes(batch.column("text"))
            starts, ends, first = word_spans(raw, at)
            tokens = Tokens(raw, at, starts, ends, first)
            y = tokens.labels(base_spans(raw, at, starts, ends))
            for what, codes in (("shape", tokens.shape * LABELS + y), ("near", y[tokens.near[:, 0]] * LABELS + y[tokens.near[:, 1]]), ("skip", y[tokens.skip[:, 0]] * LABELS + y[tokens.skip[:, 1]])):
                for code, n in zip(*np.unique(codes, return_counts=True), strict=True):
                    found[what, int(code)] = found.get((what, int(code)), 0) + int(n)
        yield pa.record_batch([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["what", "code", "n"])

    small_batches(docs.sparkSession)
    sums = docs.select(docs[text].alias("text")).mapInArrow(count, "what string, code long, n long").groupBy("what", "code").agg(F.sum("n").alias("n"))
    return Field({(r.what, r.code): r.n for r in sums.collect()})


def pii_spans(docs: DataFrame, field: Field | None = None, sure: float = 0.9, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id and spans, an array of (kind, start, end, base), in code points, end exclusive, ordered by start,
    then kind.

    Without `field`, the potentials are first counted over `docs`.  Base spans are never removed or changed; added ones touch none of them.
    Null and empty texts have no spans; null ids stay; repeated rows are judged alike; other columns are ignored; an empty table gives an
    empty one.  No shuffle but the sums of the counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs, text))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def find(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            found = batch_spans(*text_bytes(batch.column("text")), shared.value, sure)
            cells = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, b, k, base in spans] for spans in found]
            yield pa.record_batch([batch.column("id"), pa.array(cells, kind)], names=["doc_id", "spans"])

    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"))
    return rows.mapInArrow(find, f"doc_id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def redacted(docs: DataFrame, field: Field | None = None, sure: float = 0.9, text: str = "text") -> DataFrame:
    """`docs` with every span of its text replaced by [EMAIL], [IP], [CARD] or [PHONE]; overlapping spans are replaced as one, by the first.

    All other columns stay as they are; null texts stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs, text))

    def replaced(batch: pa.RecordBatch) -> pa.Array:
        """The new texts; null where a text stays as it is."""
        column = batch.column("text")
        out: list[str | None] = [None] * batch.num_rows
        for j, spans in enumerate(batch_spans(*text_bytes(column), shared.value, sure)):
            if spans:
                old, parts, done = column[j].as_py(), [], 0
                for a, b, k, _ in spans:
                    if a >= done:
                        parts += [old[done:a], f"[{KINDS[k].upper()}]"]
                    done = max(done, b)
                out[j] = "".join(parts) + old[done:]
        return pa.array(out, pa.string())

    return docs.withColumn(text, F.coalesce(text_udf(replaced, "string")(docs[text]), docs[text]))

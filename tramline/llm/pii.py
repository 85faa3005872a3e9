"""Personal data by fixed patterns and a linear-chain conditional random field.

Base spans come from four patterns (e-mail, IPv4, payment card, phone), read
in linear time. A CRF over word-shape features adds spans that patterns can't
state: secrets and account numbers named by a cue, people's names after a
title, e-mail addresses spelled out and phone numbers without a country code.
It is trained on its exact likelihood from a small labelled table of generated
lines, decoded by Viterbi over all lines of a batch at once, each line one
sequence. Every feature is looked up in the vocabulary of the training table;
what that has not seen carries no weight, so unknown words stay unmarked, and
weights are drawn to zero by a Gaussian prior. A line whose best path can only
be "nothing", by the margins of its words, is not decoded. Added spans never
touch base spans, and their kinds have names of their own.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import PUNCT, SPACE, U64, Words, code_points, covered, flat, fold_case, slices, span_hashes

KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive and anchored at the start of a digit run: the same matches, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            # a later match can't begin before this sign, which no local part holds
            done = max(done, at + 1)
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the base patterns, sorted."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# ---- conditional random field

LABELS = ["O", "secret", "account", "name", "name+", "email_text", "email_text+", "phone_local", "phone_local+"]
ADDED = ["secret", "account", "name", "email_text", "phone_local"]
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = ord("X")
_CLASS[97:123] = ord("x")
_CLASS[128:] = ord("x")
_CLASS[48:58] = ord("d")
#: Punctuation by class: none, quotes, open and closed brackets, full stop, comma, colon or equals, hyphen, other.
_EDGE = np.where(PUNCT, 8, 0).astype(np.uint8)
for _c, _k in (("\"'`", 1), ("([{<", 2), (")]}>", 3), (".", 4), (",;", 5), (":=", 6), ("-_", 7)):
    _EDGE[[ord(x) for x in _c]] = _k

#: Words whose identity is a feature.
CUE_WORDS = "token key secret password passwd pwd api apikey auth bearer credential account acct iban customer member passport ssn id no nr number mr mrs ms dr prof name contact sincerely regards dear mail email e-mail write reach call phone tel telephone mobile fax cell at dot com org net edu is my our the to from by with and of in a on = :"
RUNS = 6


@lru_cache(1)
def _cue_hashes() -> np.ndarray:
    words = [w.encode() for w in CUE_WORDS.split()]
    return np.unique(span_hashes(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])))


class Features:
    """Feature columns of every word of a batch, before the vocabulary; sequences are lines.

    Columns: the word's shape (runs of capitals, small letters, digits and
    punctuation, the first few, without outer punctuation) and its
    neighbours'; the cue that it, the two words before and the three after are;
    length; which characters it has; the punctuation around it; whether it
    repeats a neighbour; the cue before and what follows it, with the kind of first letter.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        w = self.words = Words(raw, off, hashes=False)
        n = len(w.start)
        solid = ~SPACE[raw]
        core = np.flatnonzero(solid & ~PUNCT[raw])
        lo, hi = np.searchsorted(core, w.start), np.searchsorted(core, w.end)
        some = hi > lo
        # the word without outer punctuation; punctuation alone stays whole
        self.begin, self.end = w.start.copy(), w.end.copy()
        self.begin[some], self.end[some] = core[lo[some]], core[hi[some] - 1] + 1
        inside = covered(len(raw), self.begin, self.end) if n else np.zeros(len(raw), bool)
        cls = _CLASS[raw]
        step = inside.copy()
        step[1:] &= cls[1:] != cls[:-1]
        step[self.begin] = True
        runs = np.concatenate([[0], np.cumsum(step)])
        first = runs[self.begin]
        count = np.minimum(runs[self.end] - first, RUNS)
        at = np.flatnonzero(step)
        marks = at[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())] if n else at
        shape = span_hashes(cls[marks], count) + (runs[self.end] - first > RUNS).astype(U64)
        low = fold_case(raw)
        ident = span_hashes(low[inside], self.end - self.begin)
        cues = _cue_hashes()
        place = np.minimum(np.searchsorted(cues, ident), len(cues) - 1)
        cue = np.where(cues[place] == ident, place + 1, 0)
        # lines: a break or another document between two words
        breaks = np.concatenate([[0], np.cumsum(raw == 10)])
        new = np.ones(n, dtype=bool)
        if n:
            new[1:] = (breaks[w.start[1:]] > breaks[w.start[:-1]]) | (w.doc[1:] != w.doc[:-1])
        self.line = np.flatnonzero(new)

        def shifted(x: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros(n, dtype=x.dtype)
            if by > 0:
                out[by:] = x[:-by]
                for k in range(by):
                    out[self.line[self.line + k < n] + k] = 0
            elif n:
                out[:-1] = x[1:]
                out[self.line[1:] - 1] = 0
            return out

        def has(flag: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flag)])
            return total[self.end] - total[self.begin]

        size = self.end - self.begin
        digits = has((raw >= 48) & (raw <= 57))
        upper = has((raw >= 65) & (raw <= 90))
        lower = has((raw >= 97) & (raw <= 122))
        high = has(raw >= 128)
        hexa = digits + has((low >= 97) & (low <= 102))
        kind = (digits > 0) + 2 * (upper > 0) + 4 * (lower > 0) + 8 * (high > 0) + 16 * (digits * 2 > size) + 32 * (hexa == size)
        length = np.minimum(size, 47) // 3
        before = _EDGE[raw[w.start]] * (w.start < self.begin) if n else np.zeros(0, np.uint8)
        after = _EDGE[raw[self.end[: n] - (self.end == w.end)]] * (self.end < w.end) if n else np.zeros(0, np.uint8)
        again = (shifted(ident, 1) == ident) | (shifted(ident, -1) == ident)
        title = (_CLASS[raw[self.begin]] == ord("X")) + 2 * (digits > 0) if n else np.zeros(0, np.int64)
        self.columns = [
            shape, shifted(shape, 1), shifted(shape, -1), cue, shifted(cue, 1), shifted(cue, 2), shifted(cue, -1),
            shifted(cue, -2), shifted(cue, -3), length * 64 + kind, before.astype(np.int64) * 32 + after * 2 + again, (shifted(cue, 1) * 16 + shifted(after, 1)) * 4 + title, kind,
        ]


class Vocabulary:
    """Column values of the training table that at least two words have; index 0 of a column is any other value."""

    def __init__(self, f: Features):
        self.values = []
        for c in f.columns:
            v, k = np.unique(c, return_counts=True)
            self.values.append(v[k > 1])
        self.base = np.cumsum([0, *[len(v) + 1 for v in self.values]])

    def index(self, f: Features) -> np.ndarray:
        """Feature indices of every word: an array (words, columns)."""
        out = []
        for c, v, b in zip(f.columns, self.values, self.base[:-1], strict=True):
            at = np.minimum(np.searchsorted(v, c), len(v) - 1)
            out.append(np.where(v[at] == c, at + 1, 0) + b)
        return np.stack(out, axis=1)


def _lines_of(f: Features) -> tuple[np.ndarray, np.ndarray]:
    return f.line, np.diff(np.append(f.line, len(f.words.start)))


def labelled_table(rows: int = 1800, seed: int = 7) -> list[tuple[str, list[str]]]:
    """The small labelled table: lines of invented prose around personal data, a label per word."""
    rng = np.random.default_rng(seed)
    syll = "an er on th re en ti ed or st ar nd le ou ing ch es de la un mi so pa ro ver sch ge que ment é ü ñ ción über".split()
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick(syll) for _ in range(int(rng.integers(1, 6))))
    num = lambda k: "".join(str(int(x)) for x in rng.integers(0, 10, k))
    cues = CUE_WORDS.split()[:-2]
    titles = set(TITLES.split())

    def prose(k: int) -> list[tuple[str, str]]:
        """Words that are no data: common words, names of data without data, numbers, and runs of capitals of all styles."""
        out: list[tuple[str, str]] = []
        style = rng.random()
        while len(out) < k:
            r = rng.random()
            if r < 0.13:
                w = pick("at at at to of and the in is by with from on a i y e my".split())
            elif r < 0.18:
                w = pick(cues)
            elif r < 0.25:
                w = pick(["|", "=", "-", num(1), num(2), num(4), num(9), num(16), f"{num(2)}:{num(2)}", f"{num(1)}.{num(2)}", f"{num(3)}.{num(3)}.{num(2)}.{num(3)}", f"{word()}.{num(2)}@{word()}.example.com", f"{num(4)}-{num(2)}-{num(2)}", f"{num(3)}-{num(3)}", f"v{num(1)}.{num(1)}", word() + num(2)])
            else:
                w = word()
            r = rng.random()
            if out and out[-1][0].rstrip(".,:;").lower() in titles:
                w = w.lower()
            elif style > 0.85:
                w = w.upper()
            elif not out or style < 0.3 or r < 0.12 or out[-1][0][-1] in ".?!":
                w = w.capitalize()
            if rng.random() < 0.3 and w.lower() not in titles:
                w += pick([".", ".", ",", ";", "?", "***", "###", "!!", "%%%", "$$$", "&&&", '"', ")"])
            out += [(w, "O")] * (int(rng.integers(2, 8)) if rng.random() < 0.05 and w.lower() not in titles else 1)
        return out[:k]

    def name() -> list[tuple[str, str]]:
        k = int(rng.integers(1, 4))
        part = lambda i: f"{word()[0].upper()}." if i == 1 and k == 3 else word().capitalize()
        return [(part(i), "name" if i == 0 else "name+") for i in range(k)]

    def datum(kind: int) -> list[tuple[str, str]]:
        if kind == 0:
            secret = pick([lambda: "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(20, 65)))), lambda: "".join(pick("ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz0123456789") for _ in range(int(rng.integers(16, 48)))), lambda: f"{word()}{num(3)}{word().upper()}{num(2)}"])()
            cue = pick([["token", "="], ["key", "="], ["password", "="], ["secret", ":"], ["api", "key", "="], ["token:"], ["auth", "token"], ["password:"], ["apikey", "="], ["bearer"], ["secret", "is"], ["credential", "="]])
            if rng.random() < 0.2:
                cue = [c.upper() for c in cue]
            q = pick(['"', '"', "", "", "'"])
            return [(c, "O") for c in cue] + [(q + secret + q + pick(["", "", ",", ";"]), "secret")]
        if kind == 1:
            cue = pick([["account"], ["account", "number"], ["customer", "id"], ["passport", "no"], ["ssn"], ["iban"], ["iban:"], ["account:"], ["member", "no"], ["acct", "nr"], ["customer", "number"]])
            v = pick([num(8), num(9), num(10), num(12), f"{num(3)}-{num(2)}-{num(4)}", pick(["DE", "FR", "GB"]) + num(20), pick("XCKL") + num(8)])
            cue = cue + ["is"] * int(rng.random() < 0.3)
            return [(pick([c, c.capitalize()]), "O") for c in cue] + [(v + pick(["", "", ".", ","]), "account")]
        if kind == 2:
            cue = pick([["Mr"], ["Mrs"], ["Dr."], ["Prof."], ["Name:"], ["Contact:"], ["Mr."], ["Ms."], ["Dear"], ["Sincerely,"], ["regards,"]])
            return [(c, "O") for c in cue] + name()
        if kind == 3:
            at, dot = pick([("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]")])
            parts = [word(), at, word(), dot, pick(["com", "org", "net", "edu"])]
            lead = [(c, "O") for c in pick([["mail"], ["email"], ["write", "to"], ["contact"], ["reach"], []])]
            return lead + [(p, "email_text" if i == 0 else "email_text+") for i, p in enumerate(parts)]
        parts = pick([[f"({num(3)})", f"{num(3)}-{num(4)}"], [f"{num(3)}-{num(3)}-{num(4)}"], [f"{num(3)}.{num(3)}.{num(4)}"], [f"0{num(3)}", num(7)], [f"0{num(2)}", num(3), num(4)]])
        lead = pick([["call"], ["phone"], ["tel:"], ["mobile"], ["fax"], ["call", "my", "cell"], ["telephone", "number"]])
        return [(pick([c, c.capitalize()]), "O") for c in lead] + [(p, "phone_local" if i == 0 else "phone_local+") for i, p in enumerate(parts)]

    table = []
    for r in range(rows):
        cells = prose(int(rng.integers(2, 14)))
        if r % 5 > 2:
            tail = prose(int(rng.integers(0, 9)))
            cells += datum(int(rng.integers(5))) + [(w.lower() if i == 0 else w, x) for i, (w, x) in enumerate(tail)]
        table.append((" ".join(c for c, _ in cells), [x for _, x in cells]))
    return table


def _padded(lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word index of each (sequence, step), and which steps exist."""
    t = np.arange(int(lengths.max()))
    live = t[None, :] < lengths[:, None]
    return np.where(live, starts[:, None] + t[None, :], 0), live


def train(table: list[tuple[str, list[str]]], rounds: int = 70, rate: float = 0.25, spread: float = 1.5) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """Vocabulary, weights (features, labels) and transitions (labels, labels) by Adam on the exact log-likelihood.

    The prior of a weight is Gaussian with deviation ``spread``. Weights of
    values outside the vocabulary stay zero.
    """
    raw, off = flat(pa.array([t for t, _ in table], pa.large_string()))
    f = Features(raw, off)
    vocabulary = Vocabulary(f)
    index = vocabulary.index(f)
    gold = np.array([LABELS.index(x) for _, xs in table for x in xs])
    starts, lengths = _lines_of(f)
    at, live = _padded(lengths, starts)
    n_lab, n_feat = len(LABELS), int(vocabulary.base[-1])
    unknown = vocabulary.base[:-1]
    # words by feature value, for sums over them
    by_value = np.argsort(index.ravel(), kind="stable")
    present, runs = np.unique(index.ravel()[by_value], return_index=True)
    y = np.where(live, gold[at], 0)
    weight, trans = np.zeros((n_feat, n_lab)), np.zeros((n_lab, n_lab))
    state = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(trans), np.zeros_like(trans)]
    steps = at.shape[1]
    one = np.eye(n_lab)
    want_trans = np.zeros_like(trans)
    pair = live[:, 1:]
    np.add.at(want_trans, (y[:, :-1][pair], y[:, 1:][pair]), 1)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for r in range(1, rounds + 1):
        score = weight[index].sum(axis=1)
        emit = np.where(live[:, :, None], score[at], 0.0)
        alpha = np.zeros(emit.shape)
        alpha[:, 0] = emit[:, 0]
        for t in range(1, steps):
            nxt = lse(alpha[:, t - 1][:, :, None] + trans, 1) + emit[:, t]
            alpha[:, t] = np.where(live[:, t, None], nxt, alpha[:, t - 1])
        beta = np.zeros(emit.shape)
        for t in range(steps - 2, -1, -1):
            b = lse(trans[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], b, 0.0)
        z = lse(alpha[:, -1], 1)
        prob = np.exp(alpha + beta - z[:, None, None])
        diff = one[gold] - prob[live]
        grad = np.zeros_like(weight)
        grad[present] = np.add.reduceat(diff[by_value // index.shape[1]], runs, axis=0)
        grad[unknown] = 0
        joint = np.exp(alpha[:, :-1, :, None] + trans + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grad_t = want_trans - joint[pair].sum(axis=0)
        step = rate * min(1.0, 2 * (1 - r / (rounds + 1)))
        for k, (p, g) in enumerate(((weight, grad - weight / spread**2), (trans, grad_t - trans / spread**2))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += step * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return vocabulary, weight, trans


def viterbi(score: np.ndarray, trans: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cells: int = 1 << 16) -> np.ndarray:
    """Best label of each word; sequences of similar length are decoded together."""
    best = np.zeros(len(score), dtype=np.int8)
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        # as many sequences as fill about ``cells`` padded places, one at least
        width = lengths[order[at:]]
        count = max(1, int(np.searchsorted(np.arange(1, len(width) + 1) * width, cells, side="right")))
        mine = order[at : at + count]
        at += count
        ls, ss = lengths[mine], starts[mine]
        steps = int(ls.max())
        back = np.zeros((steps, len(mine), trans.shape[0]), dtype=np.int8)
        here = score[ss]
        for t in range(1, steps):
            on = slice(int(np.searchsorted(ls, t, side="right")), None)
            step = here[on][:, :, None] + trans
            back[t, on] = step.argmax(axis=1)
            here[on] = step.max(axis=1) + score[ss[on] + t]
        label = here.argmax(axis=1)
        rows = np.arange(len(mine))
        for t in range(steps - 1, -1, -1):
            on = ls > t
            best[ss[on] + t] = label[on]
            label = np.where(on, back[t][rows, label], label)
    return best


class Tagger:
    def __init__(self, vocabulary: Vocabulary, weight: np.ndarray, trans: np.ndarray):
        self.vocabulary, self.weight, self.trans = vocabulary, weight.astype(np.float32), trans.astype(np.float32)
        # what a label other than O can gain by its transitions at most, against staying at O
        self.margin = 2 * (self.trans.max() - self.trans[0, 0])

    def labels(self, f: Features) -> np.ndarray:
        """Best label of every word."""
        n = len(f.words.start)
        index = self.vocabulary.index(f)
        score = np.zeros((n, len(LABELS)), dtype=np.float32)
        for c in range(index.shape[1]):
            score += self.weight[index[:, c]]
        starts, lengths = _lines_of(f)
        # a line where no word comes near another label has the best path O
        near = score[:, 1:].max(axis=1) + self.margin >= score[:, 0]
        open_line = np.add.reduceat(near, starts) > 0 if n else np.zeros(0, bool)
        out = np.zeros(n, dtype=np.int8)
        if open_line.any():
            s, ls = starts[open_line], lengths[open_line]
            words = np.repeat(s - (np.cumsum(ls) - ls), ls) + np.arange(ls.sum())
            out[words] = viterbi(score[words], self.trans, np.cumsum(ls) - ls, ls)
        return out

    def spans(self, raw: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
        """(kind, start, end) in code points, by document."""
        f = Features(raw, off)
        out: dict[int, list[tuple[str, int, int]]] = {}
        if not len(f.words.start):
            return out
        label = self.labels(f)
        hit = np.flatnonzero(label)
        if not len(hit):
            return out
        doc = f.words.doc[hit]
        start, end = code_points(raw, off, doc, f.begin[hit]), code_points(raw, off, doc, f.end[hit])
        line = np.searchsorted(f.line, hit, side="right")
        last = (-1, -1, "")
        for i, d, s, e, k, ln in zip(hit.tolist(), doc.tolist(), start.tolist(), end.tolist(), label[hit].tolist(), line.tolist(), strict=True):
            kind = LABELS[k].rstrip("+")
            mine = out.setdefault(d, [])
            if LABELS[k].endswith("+") and last == (i - 1, ln, kind):
                mine[-1] = (kind, mine[-1][1], e)
            else:
                mine.append((kind, s, e))
            last = (i, ln, kind)
        return out


_SPELLED = re.compile(r"\S+\s+\W*at\W*\s+\S+\s+\W*dot\W*\s+\S+", re.IGNORECASE)
#: What people are introduced by.
TITLES = "mr mrs ms dr prof dear name contact sincerely regards"
_TITLED = re.compile(rf"(?:^|\W)(?:{'|'.join(TITLES.split())})[.:,]*[^\S\n]+$", re.IGNORECASE)


def sound(text: str, kind: str, start: int, end: int) -> bool:
    """The exact check of an added span: a spelled address has both its signs, and a name follows a title."""
    if kind == "email_text":
        return _SPELLED.match(text, start, end) is not None
    return kind != "name" or _TITLED.search(text[max(0, start - 20) : start]) is not None


def apart(spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that touch none of ``base``, by one pass over both in order of start."""
    if not base or not spans:
        return spans
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    out = []
    for x in spans:
        before = bisect_left(starts, x[2])
        if not before or reach[before - 1] <= x[1]:
            out.append(x)
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """Spans of personal data for every row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_account, n_name, n_email_text, n_phone_local, n_spans, found``.

    ``found`` is an array of (kind, start, end), code points, end exclusive:
    base spans by kind as listed and start, then added ones by kind and start;
    ``spans`` is the same as text. The counts of the base kinds hold base spans,
    the others added ones, ``n_spans`` all. Null and blank texts have no spans,
    an empty table gives an empty result. Of added spans that touch a base span
    the base one stays. Repeated rows each get a row; other columns are
    ignored. A long text is read whole, alone in its slice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_table()))
    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    span_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*shared.value)
        for batch in batches:
            for part in slices(batch):
                added = tagger.spans(*flat(part.column("text")))
                counts, digests, joined, found = [], [], [], []
                for d, text in enumerate(part.column("text").to_pylist()):
                    base = [(KINDS[k], s, e) for k, s, e in base_spans(text or "")]
                    new = [x for x in apart(added.get(d, []), base) if sound(text, *x)]
                    new.sort(key=lambda x: (ADDED.index(x[0]), x[1]))
                    kinds = Counter(k for k, _, _ in base + new)
                    counts.append([*(kinds[k] for k in KINDS + ADDED), len(base) + len(new)])
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    joined.append(_joined(base + new))
                    found.append([{"kind": k, "start": s, "end": e} for k, s, e in base + new])
                numbers = np.array(counts, dtype=np.int64).reshape(-1, len(KINDS) + len(ADDED) + 1)
                cols = [pa.array(numbers[:, i]) for i in range(numbers.shape[1])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *cols[: len(KINDS)], pa.array(digests), pa.array(joined), *cols[len(KINDS) :], pa.array(found, pa.list_(span_type))],
                    names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", *[f"n_{k}" for k in ADDED], "n_spans", "found"],
                )

    longs = lambda names: ", ".join(f"n_{k} long" for k in names)
    return src.mapInArrow(run, f"doc_id long, {longs(KINDS)}, base_sha256 string, spans string, {longs(ADDED)}, n_spans long, found array<struct<kind:string,start:long,end:long>>")

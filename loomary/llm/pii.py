"""Personal data: exact base patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole spans, not tokens: a candidate segment has features of its digits, groups, separators, check digit,
surroundings and words before it, and neighbouring segments have transition weights. Candidates are bounded (LONGEST
tokens), so the best segmentation and the normaliser are dynamic programs linear in the text. Tokens that no candidate
covers can only be "outside" with score zero, so a text falls apart into clusters of candidates that are decoded on their
own, exactly as the whole text would be. Spans of the base patterns are fixed segments of their kind.

The model is trained here, by the likelihood of SENTENCES generated sentences (seeded, so every run has the same weights).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

KINDS = ("email", "ip", "card", "phone")
OUT = len(KINDS)
SENTENCES, PASSES, RATE, DECAY, SEED = 700, 8, 0.4, 1e-3, 13
#: Tokens of a candidate; what the score of a candidate loses when a text is decoded (a span is added at odds of e to this).
LONGEST, CAUTION = 24, 1.5
#: Groups of digits of a phone number.
GROUPS = 6

Span = tuple[int, int, int]  # start, end (exclusive), place of its kind in KINDS


# Base patterns. Possessive quantifiers and the look-behinds change no match (what follows can't begin with what they
# took, and a leftmost match never begins inside a run of digits); they keep the search linear in the text.

_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others: every second one from the right counts double, with its digits added."""
    return sum(int(d) if k % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for k, d in enumerate(reversed(digits))) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """All spans of the base patterns by start, then kind."""
    out, last = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                last = m.end()
                out.append((start, last, 0))
    if _DIGIT.search(text):
        out += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


# Candidates.

#: Stretches that may hold a span: seven digits or more with separators between them; two words around an "at" and a "dot".
_NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:[ ().+/\[\]-]{0,4}[0-9]){6,}+")
_SIGN = r"(?:[ ]?[\[({<][ ]?(?:at|AT|At|@)[ ]?[\])}>][ ]?|[ ](?:at|AT|At)[ ]|[ ]?@[ ]?)"
_POINT = r"(?:[ ]?[\[({<][ ]?(?:dot|DOT|Dot|\.)[ ]?[\])}>][ ]?|[ ](?:dot|DOT|Dot)[ ]|[ ]?\.[ ]?)"
_WORD = r"[A-Za-z0-9_%+-]{1,64}"
_NAME_END = re.compile(rf"(?:{_WORD}{_POINT}){{0,4}}{_WORD}\Z")
_SIGN_ON = re.compile(rf"{_SIGN}(?={_WORD}{_POINT}[A-Za-z0-9-])")
_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,64}}(?:{_POINT}[A-Za-z0-9-]{{1,64}}){{1,5}}+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_LEFT_WORDS = re.compile(r"[A-Za-z]+")
#: Longest stretch in front of an "at" that may belong to it.
_BEFORE = 5 * 75

#: Words that announce a kind, or none of them.
CUES = {
    "email": "email mail e-mail contact write address courriel correo",
    "ip": "ip host server node address client gateway",
    "card": "card visa mastercard credit debit amex karte carte tarjeta",
    "phone": "phone tel telephone call fax mobile cell whatsapp telefon dial",
    "other": "version order isbn invoice ticket section chapter page date id serial number between figures from total sku part ref",
}
_CUE = {w: k for k, words in CUES.items() for w in words.split()}
_ENDINGS = frozenset("com org net edu gov io de fr es uk it eu info".split())


class Cluster:
    """Tokens (start, end), and candidate segments (first token, token after the last, kind) with their features."""

    def __init__(self, text: str, tokens: list[tuple[int, int]], segments: list[tuple[int, int, int]], fixed: frozenset = frozenset()) -> None:
        self.text, self.tokens, self.segments, self.fixed = text, tokens, segments, fixed

    def span(self, segment: tuple[int, int, int]) -> Span:
        i, j, kind = segment
        return self.tokens[i][0], self.tokens[j - 1][1], kind


def _alnum(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def _numeric(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Four groups may be an address, 13 to 19 digits with a right check digit a card, 7 to 15 in a few groups a phone number."""
    kinds = ["d" if text[s].isdigit() and text[s].isascii() else text[s] if not text[s].isalpha() else "a" for s, _ in tokens]
    for i, (start, _) in enumerate(tokens):
        if kinds[i] not in ("d", "+", "(") or _alnum(text, start - 1):
            continue
        groups, digits, seen = 0, 0, ""
        for j in range(i, min(i + LONGEST, len(tokens))):
            if kinds[j] != "d":
                if kinds[j] == "a" or kinds[j] == "+" and j > i:
                    break
                continue
            digits, groups = digits + tokens[j][1] - tokens[j][0], groups + 1
            if digits > 19:
                break
            seen += text[slice(*tokens[j])]
            if _alnum(text, tokens[j][1]):
                continue
            if groups == 4 and digits <= 12 and kinds[i] == "d":
                yield i, j + 1, 1
            if 13 <= digits and kinds[i] == "d" and luhn(seen):
                yield i, j + 1, 2
            if 7 <= digits <= 15 and groups <= GROUPS:
                yield i, j + 1, 3


def _stretches(text: str) -> list[tuple[int, int, tuple[int, int] | None]]:
    """(start, end, place of the sign or None) of stretches with candidates."""
    out: list[tuple[int, int, tuple[int, int] | None]] = []
    if _DIGIT.search(text):
        out += [(*m.span(), None) for m in _NUMBERS.finditer(text)]
    if "@" in text or any(w in text for w in ("dot", "DOT", "Dot", "at]", "at)", "at}", "at>", "AT]", "AT)", "at ]", "at )")):
        for m in _SIGN_ON.finditer(text):
            name, domain = _NAME_END.search(text[max(0, m.start() - _BEFORE) : m.start()]), _DOMAIN.match(text, m.end())
            if name and domain:
                if m[0].strip().lower() == "at" and "dot" not in domain[0].lower():
                    continue
                out.append((m.start() - len(name[0]), domain.end(), m.span()))
    return sorted(out, key=lambda x: x[:2])


def _mail(text: str, tokens: list[tuple[int, int]], starts: list[int], start: int, end: int, sign: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
    """Any word of the name may begin the address, any of the domain from the second on may end it."""
    word = lambda s: text[s].isascii() and text[s].isalnum()
    first = bisect_left(starts, sign[1])
    begins = [k for k in range(bisect_left(starts, start), bisect_left(starts, sign[0])) if word(starts[k]) and not _alnum(text, starts[k] - 1)]
    for k in range(first + 1, bisect_left(starts, end)):
        if word(starts[k]) and not _alnum(text, tokens[k][1]):
            for i in begins:
                if k + 1 - i <= LONGEST:
                    yield i, k + 1, 0


def clusters(text: str, base: list[Span]) -> Iterator[Cluster]:
    """Clusters of candidates, in order; base spans that a stretch meets are in them as fixed segments (overlapping ones: the
    first), and no candidate overlaps a base span."""
    found, k, ahead, met = _stretches(text), 0, 0, []
    while k < len(found):
        low, high, own = found[k][0], found[k][1], [found[k]]
        while k + 1 < len(found) and found[k + 1][0] <= high:
            k += 1
            high = max(high, found[k][1])
            own.append(found[k])
        k += 1
        while ahead < len(base) and base[ahead][0] < high:
            met.append(base[ahead])
            ahead += 1
        met = [b for b in met if b[1] > low]
        if any(b[0] <= low and high <= b[1] for b in met):
            continue  # nothing is left of it
        tokens = [m.span() for m in _TOKEN.finditer(text, low, high)]
        starts, ends = [s for s, _ in tokens], [e for _, e in tokens]
        taken, fixed, last = [0] * (len(tokens) + 1), set(), 0
        for s, e, kind in met:
            i, j = bisect_right(ends, s), bisect_left(starts, e)  # its tokens, those at its edges whole
            taken[i:j] = [1] * max(0, j - i)
            if last <= i < j and starts[i] >= s and ends[j - 1] <= e:
                fixed.add((i, j, kind))
                last = j
        before = [0, *accumulate(taken)]
        segments = {x for s, e, sign in own if sign for x in _mail(text, tokens, starts, s, e, sign)}
        segments |= set(_numeric(text, tokens)) if any(sign is None for _, _, sign in own) else set()
        segments = [x for x in segments if before[x[0]] == before[x[1]]]
        if segments:
            yield Cluster(text, tokens, sorted(segments) + sorted(fixed), frozenset(fixed))


# Features.


def _near(text: str, at: int, step: int) -> str:
    """What stands beside a span: nothing, a letter (past one space), a digit past separators, or the sign itself."""
    k = at if step > 0 else at - 1
    seen = ""
    for _ in range(3):
        if not 0 <= k < len(text) or text[k] == "\n":
            return seen or "edge"
        c = text[k]
        if c.isdigit():
            return "digits"
        if c.isalpha():
            return seen or "letter"
        seen = seen or ("space" if c == " " else c if c in ".,:;()[]-+/#$@" else "other")
        k += step
    return seen


def features(cluster: Cluster, segment: tuple[int, int, int]) -> list[str]:
    text, (start, end, kind) = cluster.text, cluster.span(segment)
    name, span = KINDS[kind], text[start:end]
    before = text[max(0, start - 40) : start]
    words = [w.lower() for w in _LEFT_WORDS.findall(before)[-3:]]
    cues = sorted({_CUE[w] for w in words if w in _CUE})
    out = ["bias", f"left={_near(text, start, -1)}", f"right={_near(text, end, 1)}", f"cue={'+'.join(cues) or 'none'}", *(f"cue:{c}" for c in cues)]
    if kind == 0:
        low = span.lower()
        style = "bracket" if re.search(r"[\[({<] ?(?:at|@)", low) else "word" if re.search(r" at ", low) else "sign"
        dots = "bracket" if re.search(r"[\[({<] ?(?:dot|\.)", low) else "word" if " dot " in low else "point"
        last = _LEFT_WORDS.findall(low)[-1:] or [""]
        parts = len(re.findall(r"[a-z0-9-]+", low))
        out += [f"style={style}", f"dots={dots}", f"{style}+{dots}", f"ending={last[0] in _ENDINGS}", f"ending={min(len(last[0]), 5)}", f"parts={min(parts, 8)}", f"spaces={min(span.count(' '), 4)}", f"wide={' @' in span or '@ ' in span}"]
        rest = text[end : end + 8]
        out.append(f"more={bool(re.match(_POINT + '[A-Za-z0-9]', rest))}")
    else:
        groups = re.findall(r"[0-9]+", span)
        digits = "".join(groups)
        shape = "-".join(str(len(g)) for g in groups) if len(groups) <= 5 else "many"
        between = re.findall(r"[^0-9]+", span[1:] if span[0] in "+(" else span)
        out += [f"digits={len(digits)}", f"shape={shape}", f"seps={'|'.join(sorted(set(between)))[:12]}", f"plus={span[0] == '+'}", f"round={'(' in span}", f"open={span.count('(') - span.count(')')}", f"one={len(groups) == 1}"]
        out += [f"octets={all(map(_octet, groups))}", f"zeros={any(len(g) > 1 and g[0] == '0' for g in groups)}"] if kind == 1 else []
        out += [f"alike={len(set(between)) <= 1}", f"cue={'+'.join(cues) or 'none'}&digits={len(digits)}"]
    return [f"{name}:{x}" for x in out]


# The field.


class Field:
    """Weights of features by name, and of transitions between kinds (OUT last)."""

    def __init__(self, weights: dict[str, float] | None = None, moves: np.ndarray | None = None) -> None:
        self.weights, self.moves = weights or {}, np.zeros((OUT + 1, OUT + 1)) if moves is None else moves

    def scores(self, cluster: Cluster, caution: float = CAUTION) -> list[float]:
        return [0.0 if s in cluster.fixed else sum(self.weights.get(f, 0.0) for f in features(cluster, s)) - caution for s in cluster.segments]

    def decode(self, cluster: Cluster, caution: float = CAUTION) -> list[Span]:
        """The best segmentation's spans beside the fixed segments, which are in each."""
        n, scores = len(cluster.tokens), self.scores(cluster, caution)
        held = {t for i, j, _ in cluster.fixed for t in range(i, j)}
        ends: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for (i, j, kind), s in zip(cluster.segments, scores, strict=True):
            ends[j].append((i, kind, s))
        best = np.full((n + 1, OUT + 1), -np.inf)
        best[0, OUT] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            for i, kind, s in [*ends[j], *([] if j - 1 in held else [(j - 1, OUT, 0.0)])]:
                came = best[i] + self.moves[:, kind]
                prev = int(came.argmax())
                if came[prev] + s > best[j, kind]:
                    best[j, kind], back[j, kind] = came[prev] + s, (i, prev)
        at, kind, out = n, int((best[n] + self.moves[:, OUT]).argmax()), []
        while at:
            i, prev = back[at, kind]
            if kind != OUT and (i, at, kind) not in cluster.fixed:
                out.append(cluster.span((i, at, kind)))
            at, kind = i, prev
        return out[::-1]


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exp."""
    top = np.maximum(x.max(axis=axis, keepdims=True), -1e300)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _fit(cluster: Cluster, gold: set[tuple[int, int, int]], columns: list[np.ndarray], w: np.ndarray, moves: np.ndarray) -> tuple[list[float], np.ndarray, float]:
    """Of the log likelihood of the gold segmentation: gradient by segment's score and by transition, and its value."""
    n, kinds = len(cluster.tokens), OUT + 1
    scores = [w[c].sum() for c in columns]
    segments = [*zip(cluster.segments, scores, strict=True), *(((t, t + 1, OUT), 0.0) for t in range(n))]
    by_end: list[list] = [[] for _ in range(n + 1)]
    by_start: list[list] = [[] for _ in range(n + 1)]
    for (i, j, k), s in segments:
        by_end[j].append((i, k, s))
        by_start[i].append((j, k, s))
    alpha, into = np.full((n + 1, kinds), -1e300), np.full((n + 1, kinds), -1e300)
    alpha[0, OUT] = 0
    for j in range(n + 1):
        for k in {k for _, k, _ in by_end[j]}:
            alpha[j, k] = _sum(np.array([into[i, k] + s for i, kk, s in by_end[j] if kk == k]), 0)
        into[j] = _sum(alpha[j][:, None] + moves, 0)
    total = into[n, OUT]
    beta, onward = np.full((n + 1, kinds), -1e300), np.full((n + 1, kinds), -1e300)
    beta[n] = moves[:, OUT]
    expected = np.zeros((kinds, kinds))
    expected[:, OUT] += np.exp(alpha[n] + moves[:, OUT] - total)
    for i in range(n - 1, -1, -1):
        for k in {k for _, k, _ in by_start[i]}:
            onward[i, k] = _sum(np.array([s + beta[j, k] for j, kk, s in by_start[i] if kk == k]), 0)
        beta[i] = _sum(moves + onward[i][None, :], 1)
        expected += np.exp(np.minimum(alpha[i][:, None] + moves + onward[i][None, :] - total, 0))
    grad = [(x in gold) - float(np.exp(min(into[x[0], x[2]] + s + beta[x[1], x[2]] - total, 0))) for x, s in zip(cluster.segments, scores, strict=True)]
    seen, prev, at, value = np.zeros((kinds, kinds)), OUT, 0, -total
    starts = {i: (j, k) for i, j, k in gold}
    score = dict(zip(cluster.segments, scores, strict=True))
    while at < n:
        j, k = starts.get(at, (at + 1, OUT))
        seen[prev, k] += 1
        value += moves[prev, k] + score.get((at, j, k), 0.0)
        at, prev = j, k
    seen[prev, OUT] += 1
    return grad, seen - expected, float(value + moves[prev, OUT])


def train(sentences: list[tuple[str, list[Span]]], passes: int = PASSES, rate: float = RATE, decay: float = DECAY) -> Field:
    """A field fitted by AdaGrad to the likelihood of labelled sentences; spans that are no candidates don't count."""
    names: dict[str, int] = {}
    made = []
    for text, spans in sentences:
        for c in clusters(text, []):
            gold = {s for s in c.segments if c.span(s) in spans}
            made.append((c, gold, [np.array([names.setdefault(f, len(names)) for f in features(c, s)]) for s in c.segments]))
    w, moves = np.zeros(len(names)), np.zeros((OUT + 1, OUT + 1))
    seen, moved, order = np.full(len(names), 1e-6), np.full(moves.shape, 1e-6), Random(SEED)
    for _ in range(passes):
        order.shuffle(made)
        for c, gold, columns in made:
            grad, by_move, _ = _fit(c, gold, columns, w, moves)
            step: dict[int, float] = {}
            for g, at in zip(grad, columns, strict=True):
                for k in at.tolist() if abs(g) > 1e-6 else ():
                    step[k] = step.get(k, 0.0) + g
            for k, g in step.items():
                g -= decay * w[k]
                seen[k] += g * g
                w[k] += rate * g / seen[k] ** 0.5
            by_move[OUT, OUT] = 0  # outside to outside is the zero of the scale
            moved += by_move**2
            moves += rate * by_move / moved**0.5
    return Field({f: float(w[k]) for f, k in names.items() if abs(w[k]) > 1e-4}, moves)


# Training sentences.


def _checked(r: Random, n: int, first: str) -> str:
    body = first + "".join(str(r.randrange(10)) for _ in range(n - 1 - len(first)))
    return body + next(str(d) for d in range(10) if luhn(f"{body}{d}"))


def _some(r: Random, n: int) -> str:
    return "".join(str(r.randrange(10)) for _ in range(n))


def _email(r: Random) -> str:
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))
    at, dot = r.choice([("@", "."), (" @ ", "."), ("@", " . "), (" [at] ", "."), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), (" AT ", " DOT "), ("{at}", "."), ("@", "[.]"), ("<at>", " dot ")])
    local = word() + r.choice(["", "", _some(r, 2), (" dot " if dot == " dot " else ".") + word()])
    return local + at + dot.join([word(), *([word()] if r.random() < 0.3 else []), r.choice(sorted(_ENDINGS))])


def _address(r: Random) -> str:
    return r.choice([".", "[.]", " . ", "(.)", ".", "-"]).join(str(r.randint(0 if k else 1, 255)) for k in range(4))


def _number(r: Random) -> str:
    a, b, c = f"{r.randint(2, 9)}{_some(r, 2)}", _some(r, 3), _some(r, 4)
    country = r.choice(["", "", "+1 ", "+1-", "+1.", "1-", "001 "])
    forms = [f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"{a}{b}{c}"]
    abroad = [f"+{r.randint(20, 99)} {r.randint(10, 99)} {_some(r, 4)} {_some(r, 4)}", f"00{r.randint(20, 99)} {_some(r, 3)} {_some(r, 6)}", f"0{_some(r, 2)} {_some(r, 2)} {_some(r, 2)} {_some(r, 2)} {_some(r, 2)}"]
    return country + r.choice(forms) if r.random() < 0.75 else r.choice(abroad)


def _plastic(r: Random) -> str:
    if r.random() < 0.15:
        d = _checked(r, 15, "37")
        return r.choice([" ", "-", ".", "  "]).join([d[:4], d[4:10], d[10:]])
    d, sep = _checked(r, 16, r.choice("4 51 52 6011".split())), r.choice([" ", "-", ".", "  ", " - ", "/", ""])
    return sep.join(d[k : k + 4] for k in range(0, 16, 4))


def _harmless(r: Random) -> tuple[str, str]:
    """(words before, text) of numbers and signs that are no personal data."""
    bad = _checked(r, 16, "4")
    bad = bad[:-1] + str((int(bad[-1]) + r.randint(1, 9)) % 10)
    year = r.randint(1900, 2030)
    return r.choice([
        ("date", f"{year}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"), ("on", f"{year}/{r.randint(1, 12):02d}/{r.randint(1, 28):02d} {r.randint(0, 23):02d}.{_some(r, 2)}"), ("from", f"{year}-{year + 4} ({_some(r, 3)})"),
        ("version", f"{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 99)}.{_some(r, 4)}"), ("section", ".".join(str(r.randint(1, 20)) for _ in range(5)) + "." + _some(r, 3)), ("total", f"{_some(r, 1)} {_some(r, 3)} {_some(r, 3)}.{_some(r, 2)}"),
        ("isbn", f"978-{_some(r, 1)}-{_some(r, 2)}-{_some(r, 6)}-{_some(r, 1)}"), ("order", f"{_some(r, 4)}-{_some(r, 4)}-{_some(r, 4)}"), ("serial", bad), ("number", " ".join(bad[k : k + 4] for k in range(0, 16, 4))), ("number", "-".join(bad[k : k + 4] for k in range(0, 16, 4))),
        ("figures", " ".join(_some(r, r.randint(1, 4)) for _ in range(r.randint(5, 14)))), ("id", _some(r, r.randint(7, 22))), ("sku", f"{_some(r, 3)}-{_some(r, 7)}"), ("ticket", _some(r, 10)), ("ref", f"{_some(r, 3)} {_some(r, 3)} {_some(r, 4)}"), ("part", f"{_some(r, 3)}.{_some(r, 3)}.{_some(r, 4)}"), ("and", _some(r, 8)), ("of", _some(r, 10)), ("the", f"{_some(r, 5)} {_some(r, 5)}"), ("to", " ".join(_some(r, 2) for _ in range(6))),
        ("we met", "at noon . the end"), ("look", "at the dot on it"), ("meet me", "at five dot sharp"), ("handle", "@someone . next"), ("buy", "apples @ 3 . each"), ("ratio", f"{_some(r, 3)}/{_some(r, 4)}"), ("put", "points at a dot in space"),
    ])


def sentences(n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Generated sentences with their spans."""
    r, out = Random(seed), []
    filler = "the of and to we in that it was for on are as with his they be at one have this from or had by word but what some can out other were all there when up use your how said an each she which do their time if will way about many then them write would like so these her long make thing see him two has look more day could go come did".split()
    makers: list[Callable[[Random], str]] = [_email, _address, _plastic, _number]
    for _ in range(n):
        text, spans = " ".join(r.choice(filler) for _ in range(r.randint(0, 6))), []
        for _ in range(r.choice([1, 1, 1, 2])):
            if r.random() < 0.5:
                kind = r.randrange(OUT)
                cue = r.choice([w for w in CUES[KINDS[kind]].split() if "-" not in w]) if r.random() < 0.6 else r.choice(filler)
                value = makers[kind](r)
                text = f"{text} {cue}{r.choice(['', ':', ' is'])} ".lstrip()
                spans.append((len(text), len(text) + len(value), kind))
            else:
                cue, value = _harmless(r)
                text = f"{text} {cue if r.random() < 0.7 else r.choice(filler)} ".lstrip()
            text += value + r.choice([" ", ". ", ", ", " ", "! "])
            text += " ".join(r.choice(filler) for _ in range(r.randint(1, 5)))
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def model() -> Field:
    return train(sentences())


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """What the field finds beside the base spans; none overlaps one."""
    return [s for c in clusters(text, base) for s in field.decode(c)]


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def spans_column(text: Column, field: Field | None = None) -> Column:
    """A struct of `base` and `added`: spans of a text in code points (start, end, kind), by start and kind.

    Null and empty texts have none. A text is read whole, whatever its length.
    """
    field = field or model()
    kind = "array<struct<start: int, end: int, kind: string>>"

    @F.pandas_udf(f"base {kind}, added {kind}")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rows = lambda spans: [{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in spans]
        for batch in batches:
            found = [(base := base_spans(t or ""), added_spans(t or "", base, field)) for t in batch]
            yield pd.DataFrame({"base": [rows(b) for b, _ in found], "added": [rows(a) for _, a in found]}, columns=["base", "added"])

    return find(text)


def personal_data(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """`docs` plus `personal` (a column of that name is replaced): spans_column() of the text. Rows are independent, so nulls,
    repeats and an empty table need no case of their own."""
    return docs.withColumn("personal", spans_column(F.col(f"`{text_col}`"), field))


def masked(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """`docs` with each span of the text replaced by its kind in brackets; of overlapping spans the first one's place counts."""
    field = field or model()

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else mask_text(t, field) for t in batch], dtype=object)

    return docs.withColumn(text_col, mask(F.col(f"`{text_col}`")))


def mask_text(text: str, field: Field) -> str:
    base, out, at = base_spans(text), [], 0
    for s, e, k in sorted([*base, *added_spans(text, base, field)]):
        if s >= at:
            out.append(f"{text[at:s]}[{KINDS[k]}]")
        at = max(at, e)
    return "".join([*out, text[at:]])


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and digest of the base spans, and all spans, of every document."""
    field = model()

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        place = {k: i for i, k in enumerate(KINDS)}
        plain = lambda spans: [(s["start"], s["end"], place[s["kind"]]) for s in spans]
        for batch in batches:
            rows = []
            for base, added in ((plain(x["base"]), plain(x["added"])) for x in batch.to_dict("records")):
                rows.append((*(sum(k == i for _, _, k in base) for i in range(OUT)), sha256(_listed(base).encode()).hexdigest(), _listed([*base, *added])))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    found = personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"), field=field)
    return found.select("doc_id", digest("personal").alias("d")).select("doc_id", "d.*")

"""Personal data by fixed patterns and a semi-Markov conditional random field.

The field labels whole segments of white-space separated chunks: a segment of up to ``MOST_CHUNKS`` chunks is an
e-mail address, an IP address, a payment card, a phone number or other text (one chunk). Features look at the whole
span: shape, digit count, checksum, octets, separators, the word before it and numbers beside it. Phone numbers have the
shapes of five countries; those that any column of numbers shows as well (``NXX NXX XXXX``) count only after a word that
announces a phone, and none does after a word that announces a count or beside further numbers. Decoding is a dynamic program over
segment ends and types, bounded by ``MOST_CHUNKS``, so boundaries and types are chosen jointly. Only runs of chunks
with a digit, an ``@`` or a bracketed ``at``, and in a run with such an ``at`` of a bracketed ``dot`` and what stands
after either, are candidates; each run is decoded whole and by itself, however long it or its chunks are. A domain with
a blank beside a bare dot ends there, and an address of more than ``MOST_CHUNKS`` chunks (three spaced dots) is found only
in part.

Weights maximise the penalised likelihood of ``SENTENCES`` labelled sentences made from a seed; nothing of the
corpus is used. Spans of the fixed patterns always stay; the field adds spans that overlap none of them.

Cases: null text counts as empty; no match gives zero counts, an empty ``spans`` and the digest of the empty string;
very long texts are read whole; spans that start together can't be of two kinds of the field. Repeated rows keep one
result each; an empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.base import slices, table, text_of

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
MOST_CHUNKS = 7
SENTENCES = 900
EPOCHS = 40

# Fixed patterns. A start inside a run of digits can't match where the run's first digit didn't.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the fixed patterns, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if octets(m[0]):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# The field's features of a whole span.
_SHAPE_EMAIL = re.compile(r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SHAPE_HIDDEN = re.compile(r"[\w.%+-]+ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]+)+")
_SHAPE_IP = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
# Phone numbers: with a bracketed area code, as a country writes it, and as it may also be a list of numbers.
_SHAPE_AREA = re.compile(r"(?:[+]?[0-9]{1,3}[ .-])?\([0-9]{2,5}\) ?[0-9]{3,4}[ .-][0-9]{3,4}")
_SHAPE_US = re.compile(r"(?:[+]?[0-9]{1,2}[ .-])?[2-9][0-9]{2}([.-])[2-9][0-9]{2}\1[0-9]{4}")
_SHAPE_TRUNK = re.compile(
    r"0[1-9](?:[ .][0-9]{2}){4}|02[0-9] [0-9]{4} [0-9]{4}|01[0-9]{2} [0-9]{3} [0-9]{4}|0[17][0-9]{3} [0-9]{6}|0[1-9][0-9]{1,3}[ /-][0-9]{6,8}"
)
_SHAPE_LOOSE = re.compile(r"(?:[0-9]{1,2} )?[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}|[69][0-9]{2}(?: [0-9]{2}){3}|[69][0-9]{2} [0-9]{3} [0-9]{3}")
_SHAPE_334 = re.compile(r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}")
_SHAPE_CARD = re.compile(r"[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}")
_TRIGGER = re.compile(r"[0-9@]|[\[(] ?(?:at|AT) ?[\])]")
_SPACE, _WORD = re.compile(r"\s"), re.compile(r"\S")
_MARK = re.compile(r"[\[(] ?(?:(at|AT)|dot) ?[\])]")
_ENDS = " \t\n\r\x0b\x0c.,;:!?\"'|*#$%&<>{}=~`"
_NUMBER = re.compile(r"[0-9]+")
# Words that announce a kind, and words that announce a count or a label.
_CUE_WORDS = (
    "phone tel call mobile fax dial ring telephone cell telefon anruf handy rufnummer mobil téléphone tél appelez portable teléfono llame móvil",
    "card visa credit mastercard karte carte tarjeta",
    "email mail contact e-mail write correo courriel",
    "ip host server address gateway",
    "order orders table size sizes id ids row rows item items total invoice part parts serial model lot ref code count counts sum page pages section isbn sku values years scores batch ticket case",
)
CUES = {word: kind for kind, line in enumerate(_CUE_WORDS) for word in line.split()}
COUNT = len(_CUE_WORDS) - 1
FEATURES = 33


def features(span: str, before: str, chunks: int, beside: bool = False) -> np.ndarray:
    """Of a span, the word before it, and whether a bare number stands right beside it."""
    f = np.zeros(FEATURES)
    f[0] = 1
    digits = "".join(_DIGITS.findall(span)) if span.isascii() else "".join(c for c in span if "0" <= c <= "9")
    n = len(digits)
    f[1] = _SHAPE_EMAIL.fullmatch(span) is not None
    f[2] = _SHAPE_HIDDEN.fullmatch(span) is not None
    if _SHAPE_IP.fullmatch(span):
        f[3 if octets(span) else 4] = 1
    shaped = _SHAPE_CARD.fullmatch(span) is not None
    if shaped and 12 <= n <= 19:
        f[5 if luhn(digits) else 6] = 1
    if span.startswith("+") and 9 <= n <= 15:
        f[7] = 1
    if 8 <= n <= 14:
        f[8] = _SHAPE_AREA.fullmatch(span) is not None
        f[24] = _SHAPE_US.fullmatch(span) is not None
        f[25] = _SHAPE_TRUNK.fullmatch(span) is not None
        f[26] = _SHAPE_LOOSE.fullmatch(span) is not None
    f[9] = n < 7
    f[10] = any(c.isalpha() for c in span)
    f[11] = span.isdigit()
    f[12] = 7 <= n <= 11
    f[13] = n > 19
    cue = CUES.get(before.strip(_ENDS).lower())
    if cue is not None:
        f[14 + cue] = 1
    f[19] = chunks > 1
    f[20] = chunks > 3
    f[21] = "@" in span
    f[22] = span.count("(") != span.count(")")
    phone = f[8] or f[24] or f[25] or f[26]
    f[23] = shaped or phone or f[3] or f[1] or f[2]
    f[27] = span[:1] in _ENDS or span[-1:] in _ENDS
    f[28] = f[26] and cue == 0
    f[29] = phone and not f[8] and cue == COUNT
    f[30] = phone and not f[8] and chunks > 1 and beside
    f[31] = not phone and _SHAPE_334.fullmatch(span) is not None
    f[32] = f[31] and cue == 0
    return f


def _trimmed(text: str, start: int, stop: int) -> tuple[int, int]:
    while start < stop and text[start] in _ENDS:
        start += 1
    while start < stop and text[stop - 1] in _ENDS:
        stop -= 1
    if start < stop and text[start] == "(" and ")" not in text[start:stop]:
        start += 1
    if start < stop and text[stop - 1] == ")" and "(" not in text[start:stop]:
        stop -= 1
    return start, stop


def _segments(text: str, chunks: list[tuple[int, int]], before: str) -> tuple[list, np.ndarray]:
    """Candidate segments (first, last + 1, start, stop) and their features; single chunks first as other text."""
    where, rows = [], []
    for i in range(len(chunks)):
        prior = text[slice(*chunks[i - 1])] if i else before
        number_before = _NUMBER.fullmatch(prior) is not None
        for j in range(i + 1, min(len(chunks), i + MOST_CHUNKS) + 1):
            start, stop = _trimmed(text, chunks[i][0], chunks[j - 1][1])
            if stop > start or j == i + 1:
                number_after = j < len(chunks) and stop == chunks[j - 1][1] and "0" <= text[chunks[j][0]] <= "9"
                where.append((i, j, start, stop))
                rows.append(features(text[start:stop], prior, j - i, number_before or number_after))
    return where, np.array(rows)


def _lattice(where: list, scores: np.ndarray, n: int, follow: np.ndarray, best: bool):
    """Sums (or maxima, with where they came from) over labelled segmentations, by segment end and type."""
    kinds = OTHER + 1
    total = np.full((n + 1, kinds), -np.inf)
    came: dict = {}
    by_end: dict[int, list[int]] = {}
    for s, (_, j, _, _) in enumerate(where):
        by_end.setdefault(j, []).append(s)
    for j in range(1, n + 1):
        for s in by_end.get(j, ()):
            i = where[s][0]
            into = np.zeros(kinds) if i == 0 else None
            if into is None:
                paths = total[i][:, None] + follow
                into = paths.max(axis=0) if best else np.logaddexp.reduce(paths, axis=0)
            here = into + scores[s]
            if j - i > 1:
                here[OTHER] = -np.inf
            for y in range(kinds):
                if here[y] == -np.inf:
                    continue
                if best:
                    if here[y] > total[j, y]:
                        total[j, y] = here[y]
                        came[j, y] = (s, int(np.argmax(total[i] + follow[:, y])) if i else None)
                else:
                    total[j, y] = np.logaddexp(total[j, y], here[y])
    return (total, came) if best else total


def decoded(where: list, rows: np.ndarray, n: int, weights: np.ndarray, follow: np.ndarray) -> list[tuple[int, int]]:
    """(segment, kind) of the best labelled segmentation."""
    total, came = _lattice(where, rows @ weights.T, n, follow, True)
    j, y, out = n, int(np.argmax(total[n])), []
    while j:
        s, before = came[j, y]
        out.append((s, y))
        j, y = where[s][0], before
    return out[::-1]


# How five countries write phone numbers (#: any digit, Z: 1 to 9, N: 2 to 9); loose ones need a cue.
AREA_SHAPES = "(N##) N##-####|(###) ###-####|(0Z##) ###-####|(0Z#) ####-####|(###) ### ####"
PHONE_SHAPES = "N##-N##-####|N##.N##.####|1-N##-N##-####|020 #### ####|01## ### ####|01### ######|07### ######|0Z# #######|0Z#/#######|0Z##-######|0Z## ########|0Z ## ## ## ##|0Z.##.##.##.##"
LOOSE_SHAPES = "N## N## ####|6## ### ###|9## ## ## ##|9## ### ###"
LOOSE = OTHER + 1


def _made(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A labelled sentence: text and (start, stop, kind)."""
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(valid: bool) -> str:
        body = "4" + digits(14)
        right = next(str(d) for d in range(10) if luhn(body + str(d)))
        number = body + (right if valid else str((int(right) + rng.randrange(1, 10)) % 10))
        sep = rng.choice(["", " ", "-"] if not valid else ["", " ", "-", "."])
        return sep.join(number[i : i + 4] for i in range(0, 16, 4))

    def phone(shapes: str) -> str:
        shape = rng.choice(shapes.split("|"))
        return "".join(digits(1) if c == "#" else str(rng.randrange(2, 10)) if c == "N" else str(rng.randrange(1, 10)) if c == "Z" else c for c in shape)

    ip = lambda top: ".".join(str(rng.randrange(256, 999) if k == top else rng.randrange(256)) for k in range(4))
    host = lambda: f"{word()}.{rng.choice(['com', 'org', 'net'])}"
    dot = lambda: rng.choice([" (dot) ", " [dot] "])
    spaced = lambda: word() + (dot() + word()) * rng.randrange(2) + dot() + rng.choice(["com", "org", "net"])
    entity = [
        (0, lambda: f"{word()}.{digits(2)}@{host()}"),
        (0, lambda: f"{word()} {rng.choice(['(at)', '[at]'])} {rng.choice([host, spaced])()}"),
        (1, lambda: ip(-1)),
        (2, lambda: card(True)),
        (3, lambda: rng.choice(["", "", "+1 ", "+49 ", "1-"]) + phone(AREA_SHAPES)),
        (3, lambda: phone(PHONE_SHAPES)),
        (3, lambda: phone(PHONE_SHAPES)),
        (LOOSE, lambda: phone(LOOSE_SHAPES)),
    ]
    count = lambda: rng.choice(_CUE_WORDS[COUNT].split())
    decoy = [
        lambda: digits(rng.randrange(1, 6)), lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}.{digits(2)}", lambda: card(False), lambda: f"{digits(1)}.{digits(2)}.{digits(1)}", lambda: ip(rng.randrange(4)),
        lambda: digits(rng.randrange(7, 22)), lambda: f"{word()}{digits(3)}", lambda: f"@{word()}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"${digits(3)},{digits(3)}.{digits(2)}", lambda: f"{digits(4)} {digits(4)}", lambda: f"{digits(5)}-{digits(4)}-{digits(2)}",
        lambda: " ".join([rng.choice("abxyzq") + digits(1)] * rng.randrange(2, 9)), lambda: " ".join(word()[:2] + digits(rng.randrange(1, 3)) for _ in range(rng.randrange(2, 9))), lambda: " ".join(digits(rng.randrange(1, 4)) for _ in range(rng.randrange(2, 9))),
        lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"({digits(1)}) ({digits(1)})", lambda: f"{digits(2)}% {digits(2)}%", lambda: f"20{digits(2)} 20{digits(2)} 20{digits(2)}", lambda: f"{digits(2)}/{digits(2)}/20{digits(2)} {digits(2)}:{digits(2)}", lambda: f"{word()}@{word()}",
        lambda: f"{count()} {phone(LOOSE_SHAPES)}", lambda: f"{count()} {phone(PHONE_SHAPES)}", lambda: f"{count()} {phone('###-###-####|### ### ####|###.###.####')}", lambda: phone("0##-###-####|1## ### ####|0## ### ####"),
        lambda: phone(LOOSE_SHAPES), lambda: f"{phone(LOOSE_SHAPES)} {phone(LOOSE_SHAPES)}", lambda: f"{digits(3)} {phone(LOOSE_SHAPES)}", lambda: f"{phone('0Z ## ## ## ##|02# #### ####|0Z# #######')} {digits(2)}", lambda: f"{digits(2)} {phone('0Z ## ## ## ##|0Z# #######')}",
        lambda: " ".join(digits(rng.randrange(2, 5)) for _ in range(rng.randrange(3, 12))), lambda: f"97{rng.choice('89')}-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}",
    ]
    text, gold = "", []
    for _ in range(rng.randrange(2, 6)):
        text += word() + " "
        k, make = rng.choice(entity) if rng.random() < 0.45 else (OTHER, rng.choice(decoy))
        loose, k = k == LOOSE, min(k, LOOSE - 2) if k == LOOSE else k
        if loose or k < OTHER and rng.random() < 0.3:
            text += rng.choice([c for c, v in CUES.items() if v == {0: 2, 1: 3, 2: 1, 3: 0}[k]]) + rng.choice([" ", ": "])
        body = make()
        if k < OTHER:
            gold.append((len(text), len(text) + len(body), k))
        text += body + rng.choice([" ", " ", ", ", ". "])
    return text, gold


@functools.lru_cache(maxsize=4)
def trained(sentences: int = SENTENCES, epochs: int = EPOCHS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and of one kind after another: gradient ascent on the likelihood of made sentences."""
    rng, data = random.Random(seed), []
    for _ in range(sentences):
        text, gold = _made(rng)
        for chunks, before in islands(text):
            where, rows = _segments(text, chunks, before)
            marks = {(a, b): k for a, b, k in gold}
            right, at = [], 0
            while at < len(chunks):
                s = next((s for s, (i, _, a, b) in enumerate(where) if i == at and (a, b) in marks), None)
                if s is None:
                    s, k = next(s for s, (i, j, _, _) in enumerate(where) if i == at and j == at + 1), OTHER
                else:
                    k = marks[where[s][2:]]
                right.append((s, k))
                at = where[s][1]
            data.append((where, rows, len(chunks), right))
    kinds = OTHER + 1
    groups = [_stacked([d for d in data if d[2] == n], n) for n in sorted({d[2] for d in data})]
    weights, follow = np.zeros((kinds, FEATURES)), np.zeros((kinds, kinds))
    pace_w, pace_f = np.full_like(weights, 1e-6), np.full_like(follow, 1e-6)
    seen_w, seen_f = np.zeros_like(weights), np.zeros_like(follow)
    for _, rows, _, right in data:
        for k, (s, y) in enumerate(right):
            seen_w[y] += rows[s]
            if k:
                seen_f[right[k - 1][1], y] += 1
    for _ in range(epochs):
        grad_w, grad_f = seen_w - 0.05 * weights, seen_f - 0.05 * follow
        for n, rows, place in groups:
            scores = np.full((place[-1], kinds), -np.inf)
            scores[place[0]] = rows @ weights.T
            single, pair = _expected(scores.reshape(*place[1], kinds), n, follow)
            grad_w -= single.reshape(-1, kinds)[place[0]].T @ rows
            grad_f -= pair
        pace_w += grad_w**2
        pace_f += grad_f**2
        weights += 1.0 * grad_w / np.sqrt(pace_w)
        follow += 0.3 * grad_f / np.sqrt(pace_f)
    return weights, follow


def _stacked(runs: list, n: int) -> tuple:
    """Runs of ``n`` chunks as one table of features, and where its rows lie in (run, first chunk, length)."""
    most = min(n, MOST_CHUNKS)
    at = [(r * n + i) * most + j - i - 1 for r, (where, *_) in enumerate(runs) for i, j, _, _ in where]
    return n, np.concatenate([rows for _, rows, *_ in runs]), (np.array(at), (len(runs), n, most), len(runs) * n * most)


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _expected(scores: np.ndarray, n: int, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of labelled segments (run, first chunk, length, kind) and of one kind after another."""
    runs, _, most, kinds = scores.shape
    scores = scores.copy()
    scores[:, :, 1:, OTHER] = -np.inf
    total, into = np.full((runs, n + 1, kinds), -np.inf), np.zeros((runs, n, kinds))
    for j in range(1, n + 1):
        ends = [into[:, j - k] + scores[:, j - k, k - 1] for k in range(1, min(most, j) + 1)]
        total[:, j] = _sum(np.stack(ends), 0)
        if j < n:
            into[:, j] = _sum(total[:, j, :, None] + follow, 1)
    back, tail = np.full((runs, n + 1, kinds), -np.inf), np.full_like(scores, -np.inf)
    back[:, n] = 0
    for i in range(n - 1, -1, -1):
        for k in range(1, min(most, n - i) + 1):
            tail[:, i, k - 1] = scores[:, i, k - 1] + back[:, i + k]
        back[:, i] = _sum(follow + _sum(tail[:, i], 1)[:, None, :], 2)
    z = _sum(total[:, n], 1)
    single = np.exp(into[:, :, None] + tail - z[:, None, None, None])
    starts = _sum(tail[:, 1:], 2) - z[:, None, None]
    pair = np.exp(total[:, 1:n, :, None] + follow + starts[:, :, None, :]).sum(axis=(0, 1))
    return single, pair


def islands(text: str) -> Iterator[tuple[list[tuple[int, int]], str]]:
    """Runs of chunks that may hold an entity, and the word before each run.

    A chunk holds a digit, an ``@`` or a bracketed ``at``, or stands beside a bracketed ``at``; after one, a bracketed
    ``dot`` and the chunk after it belong to the run, too. The model alone says what a run is.
    """
    at, n = 0, len(text)
    while m := _TRIGGER.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        chunks = []
        if m.start() == start and text[start] in "[(":  # the local part stands before it
            stop = start
            while stop > at and text[stop - 1].isspace():
                stop -= 1
            first = stop
            while first > at and not text[first - 1].isspace():
                first -= 1
            if first < stop and start > stop:
                chunks.append((first, stop))
        pos, marked, hidden = start, -1, False  # where the last bracketed mark ends; whether an "at" came
        while pos < n:
            stop = space.start() if (space := _SPACE.search(text, pos)) else n
            inside = pos < marked or bool(chunks) and chunks[-1][1] == marked
            for mark in _MARK.finditer(text, pos, min(n, stop + 6)):
                if mark.start() < stop and (mark[1] or hidden):
                    inside, marked, hidden = True, mark.end(), True
            if not inside and not _TRIGGER.search(text, pos, stop):
                break
            chunks.append((pos, stop))
            pos = word.start() if (word := _WORD.search(text, stop)) else n
        at = max(pos if pos > start else start + 1, m.end())
        if not chunks:
            continue
        stop = chunks[0][0]
        while stop > 0 and text[stop - 1].isspace():
            stop -= 1
        first = stop
        while first > max(0, stop - 24) and not text[first - 1].isspace():
            first -= 1
        yield chunks, text[first:stop]


class Field:
    """The decoder with its weights; what short runs that come again and again decode to is kept."""

    KEPT, SHORT = 1 << 16, 64

    def __init__(self, weights: np.ndarray, follow: np.ndarray) -> None:
        self.weights, self.follow, self.known = weights, follow, {}

    def _run(self, text: str, chunks: list[tuple[int, int]], before: str) -> list[tuple[int, int, int]]:
        where, rows = _segments(text, chunks, before)
        return [(where[s][2], k, where[s][3]) for s, k in decoded(where, rows, len(chunks), self.weights, self.follow) if k < OTHER]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, stop) that the field finds."""
        out = []
        for chunks, before in islands(text):
            start, stop = chunks[0][0], chunks[-1][1]
            if stop - start > self.SHORT:
                out += self._run(text, chunks, before)
                continue
            key = text[start:stop], CUES.get(before.strip(_ENDS).lower())
            if key not in self.known:
                if len(self.known) >= self.KEPT:
                    self.known.clear()
                self.known[key] = self._run(key[0], [(a - start, b - start) for a, b in chunks], before)
            out += [(start + a, k, start + b) for a, k, b in self.known[key]]
        return out


def field_spans(text: str, weights: np.ndarray, follow: np.ndarray) -> list[tuple[int, int, int]]:
    return Field(weights, follow).spans(text)


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(text: str, field: Field) -> tuple:
    """Counts of the fixed patterns by kind, the spans that the field adds, digest and line of all spans."""
    base = base_spans(text)
    added = [s for s in field.spans(text) if not any(s[0] < b[2] and b[0] < s[2] for b in base)]
    line = _line(base)
    count = [sum(k == kind for _, k, _ in base) for kind in range(OTHER)]
    return *count, len(added), hashlib.sha256(line.encode()).hexdigest(), _line(sorted(base + added)) if added else line


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def personal_data(docs: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` for each document."""
    weights, follow = trained()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.string()] * 2
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        field = Field(weights, follow)
        for batch in slices(batches):
            found = [scanned(t.as_py(), field) for t in batch.column(1)]
            columns = zip(*found, strict=True) if found else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(scan, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))

"""Personal data: base rules, and a linear-chain conditional random field over word shapes.

The base rules find e-mail and IP addresses, card and international phone numbers. The
field finds what they can't state: secrets, national phone numbers, social security numbers
and IBANs, in one word or several. It is trained here by gradient ascent on the conditional
likelihood, from a small labelled table that a seeded generator writes (made-up words and
numbers in the formats that such data have).

Every word of every text is decoded. A word counts by its shape, its kind and what its
neighbours say, so that all that the field needs of a word are two small numbers, and the
scores of a batch of texts come from one table; Viterbi runs over all texts of a batch at once,
word by word, in numpy.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact, small_batches, table, with_row

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "national_phone", "secret", "ssn")
LABELS = ("O", *(f"{p}-{k}" for k in ADDED_KINDS for p in "BI"))
#: Rows of the labelled table, and the seed it is made from.
ROWS, SEED = 800, 11

#: Words that tell what comes next, by what they tell.
_CLUES = {
    "TEL": "phone tel telephone fax mobile call contact mobil telefon teléfono téléphone cell",
    "SEC": "token secret password passwd key api_key apikey pwd passphrase credential bearer passwort contraseña",
    "SSN": "ssn social security",
    "IBAN": "iban konto account bank compte cuenta",
    "EQ": "= : := == is :=",
}
CLUES = {w: k for k, words in _CLUES.items() for w in words.split()}
#: What a word says to its neighbours: nothing is there, a clue as above, a clue with its own "=" or ":" (which
#: is a clue, too), a sign, a word with digits, another one.
SAYS = ("NONE", "TEL", "SEC", "SSN", "IBAN", "EQ", "TEL=", "SEC=", "SSN=", "IBAN=", "SIGN", "NUM", "WORD")
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+")
_STRIP = "\"'.,;:!?|*#$%&<>[]{}`"


def shape(word: str) -> str:
    """Digits as d and their number (up to 5), words of capitals as A, with a capital first as Aa, others as
    a, mixed case as M; long mixtures of letters and digits as X and how often they change."""
    core = word.strip(_STRIP)
    alnum = sum(c.isalnum() for c in core)
    if alnum >= 15 and alnum >= 0.9 * len(core):
        digits = sum(c.isdigit() for c in core)
        if digits == alnum:
            return f"D{min(alnum, 25)}"
        turns = sum(core[k].isdigit() != core[k - 1].isdigit() for k in range(1, len(core)))
        if digits:
            return f"{'I' if core[:2].isalpha() and core[2:4].isdigit() and core.upper() == core else 'X'}{min(turns // 4, 3)}"

    def run(m: re.Match) -> str:
        part = m[0]
        if part[0] in "0123456789":
            return f"d{min(len(part), 5)}"
        return "A" if part.isupper() else "a" if part.islower() else "Aa" if part[0].isupper() and part[1:].islower() else "M"

    return _RUNS.sub(run, core)


def says(word: str) -> str:
    """What a word says to its neighbours."""
    low = word.lower().strip("\"'.,;!?|*#$%&<>[]{}`()")
    if low in CLUES:
        return CLUES[low]
    bare = low.rstrip(":=")
    if bare in CLUES and bare != low and CLUES[bare] != "EQ":
        return CLUES[bare] + "="
    return "NUM" if any(c in "0123456789" for c in word) else "WORD" if any(c.isalpha() for c in low) else "SIGN"


def kind(word: str) -> str:
    """Length, letters and digits of a word."""
    core = word.strip(_STRIP)
    letters, digits = any(c.isalpha() for c in core), any(c in "0123456789" for c in core)
    size = "L" if len(core) >= 16 else "M" if len(core) >= 7 else "S"
    return size + ("m" if letters and digits else "n" if digits else "l" if letters else "s") + ("q" if word[:1] in "\"'`" and len(word) > 2 else "")


def _before(one: str, two: str) -> str:
    """What the two words before say: "=" or "is" after a clue makes one of it."""
    return f"{two}=" if one == "EQ" and two in ("TEL", "SEC", "SSN", "IBAN") else one


#: Parts of made-up words, and templates of the labelled table: {kind} is a span, {word}, {number} and so on are not.
_PARTS = "ba de fi go lu ma ne pi ro su ta ve wo xi zu ran sil mor tek pol und ist ent ing"
_TEMPLATES = """
call me at {phone} {word}|tel: {phone}|phone {phone} {word} {word}|{word} fax {phone}|mobile {phone} {word}|{word} ( phone {phone} ) {word}|contact {phone}|tel. {phone} {word}|{word} {word} {paren} {word}|{word} {paren}
my ssn is {ssn} {word}|ssn: {ssn}|social security {ssn} {word}|{word} {ssn} {word}|{word} {word} {ssn}|ssn {ssn}
iban {iban} {word}|iban: {iban}|{word} {iban} {word}|account {iban}|konto {iban} {word}|{word} {word} {iban}
token = {secret} {word}|api_key = {secret}|secret: {secret} {word}|password = {password} {word}|password: {password}|passwd = {password}|key = {secret} {word}|token {hex} {word}|api_key: {secret}|pwd: {password} {word}|{word} token = {secret}|{word} password is {mixedpass}|{word} {hex} {word}|token: {password}|secret = {secret}|bearer {hex}|password = {password}
{word} {word} {word}|{word} {word} {cap} {word}|{word} {number} {word}|{word} {cap} {word} {number}|{cap} {word}, {word} {word}.|{word} {date} {word}|{word} version {version} {word}|{word} {card} {word}|{word} {ip} {word}|{word} {mail} {word}|{word} {intl} {word}|{word} in {year} {word}|pages {number} to {number}|{word} {range} {word}|{cap} {cap} {word}|{upper} {upper} {upper}|| {word} | {number} | {word} ||{word} {code} {word}|{word}!! {word}!!|{card}!! {word}|{number}. {word}|{word}: {word}|{word} = {word}|{word} is {word}
password reset in {number} hours|token of {word}|the key is {word}|secret {word} {word}|phone call {word}|the {word} account {word}|key {number} {word}|a social {word}|bank of {word}|call {number} {word}|{word} token {word}|the password was {word}|{word} phone {word} {word}|mobile {word}|is {word}|key {word} {word}|account {number} {word}|contact {word}|{word} security {word}|secret of {year}|{word} key and {word}|password and {word}|phone {number} of {number}|account {card} {word}|{word} number {card}|key {cap} {word}|token {number}|{upper} KEY {upper}
"""
#: The placeholders that are spans, by kind.
_SPANS = {"phone": "national_phone", "paren": "national_phone", "ssn": "ssn", "iban": "iban", "secret": "secret", "password": "secret", "mixedpass": "secret", "hex": "secret"}


class _Maker:
    """Made-up words and data from a seed."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.parts = _PARTS.split()

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def some(self, letters: str, low: int, high: int) -> str:
        return "".join(self.rng.choice(letters) for _ in range(self.rng.randint(low, high)))

    def word(self) -> str:
        return "".join(self.rng.choice(self.parts) for _ in range(self.rng.randint(1, 6))) + self.rng.choice(["", "", "", "", ",", "."])

    def number(self) -> str:
        return self.rng.choice([self.digits(self.rng.randint(1, 6)), f"{self.digits(1)},{self.digits(3)}", f"{self.digits(2)}.{self.digits(2)}", f"${self.digits(3)}", f"{self.digits(2)}%"])

    def hex(self) -> str:
        out = self.some("0123456789abcdef", 32, 64)
        return out.upper() if self.rng.random() < 0.2 else out

    def secret(self) -> str:
        out = self.rng.choice([self.hex(), self.some("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 20, 44), self.some("abcdefghijklmnop", 2, 3) + "_" + self.some("ABCDEFabcdefghij0123456789", 20, 36), self.some("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 24), self.some("ABCDEFGHIJKLMabcdefghijklmn", 16, 30)])
        return self.rng.choice(['"{}"', "{}", "'{}'"]).format(out)

    def password(self) -> str:
        out = self.rng.choice([self.mixedpass(), self.some("abcdefghijklmnopqrstuvwxyz", 10, 24), self.some("ABCDEFGHabcdefghijklmn", 9, 15), self.some("abcdefgh", 5, 8) + "-" + self.some("abcdefgh", 4, 8), self.some("abcdefghi0123456789!$%", 9, 14)])
        return self.rng.choice(['"{}"', "{}", "{}"]).format(out)

    def mixedpass(self) -> str:
        return self.some("abcdefghijklmn", 3, 7) + self.digits(self.rng.randint(1, 3)) + self.some("abcdefgABCDEFG", 1, 5)

    def phone(self) -> str:
        d = self.digits
        return self.rng.choice([self.paren(), f"{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(7)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)} {d(6)}", f"{d(3)}.{d(3)}.{d(4)}"])

    def paren(self) -> str:
        return f"({self.digits(3)}) {self.digits(3)}-{self.digits(4)}"

    def ssn(self) -> str:
        return f"{self.digits(3)}-{self.digits(2)}-{self.digits(4)}"

    def iban(self) -> str:
        n = self.rng.randint(12, 26)
        body = "".join(self.rng.choice("ABCDEFGHKLMNPR" if lettered else "0123456789") for lettered in [self.rng.random() < 0.6] * 4 + [False] * (n - 4))
        out = self.rng.choice(["AT", "BE", "CH", "DE", "ES", "FR", "GB", "IT", "NL", "PL", "SE"]) + self.digits(2) + body
        return out if self.rng.random() < 0.5 else " ".join(out[k : k + 4] for k in range(0, len(out), 4))

    def other(self, name: str) -> str:
        d = self.digits
        return {
            "cap": lambda: self.word().capitalize(), "upper": lambda: self.word().upper(), "year": lambda: "19" + d(2), "version": lambda: f"{d(1)}.{d(1)}.", "date": lambda: self.rng.choice([f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/19{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}"]),
            "card": lambda: d(16), "ip": lambda: ".".join(str(self.rng.randint(0, 255)) for _ in range(4)), "mail": lambda: f"{self.rng.choice(self.parts)}.{d(2)}@{self.rng.choice(self.parts)}{d(1)}.example.com", "intl": lambda: self.rng.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(6)}", f"+{d(2)} {d(3)} {d(7)}"]),
            "range": lambda: self.rng.choice([f"{d(2)}-{d(2)}", f"{d(4)}-{d(4)}", f"{d(1)}-{d(1)}", f"{d(3)}-{d(2)}"]), "code": lambda: self.rng.choice([self.some("abcdefg", 1, 3) + d(2), self.some("ABCDEF", 1, 2) + d(3), self.some("abc", 1, 1) + d(1) + self.some("abc", 1, 1) + d(1), d(2) + "th"]),
        }[name]()


def labelled(rows: int = ROWS, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with spans (kind, start, end in code points), from templates between made-up words."""
    made = _Maker(seed)
    groups = [[t.replace("\0", "|") for t in line.replace("| {", "\0 {").replace("} |", "} \0").split("|") if t] for line in _TEMPLATES.strip().splitlines()]
    out = []
    for _ in range(rows):
        text, spans = "", []
        for template in (made.rng.choice(made.rng.choice(groups)) for _ in range(made.rng.randint(1, 3))):
            text += " " if text else ""
            for piece in re.split(r"(\{\w+\})", template):
                if not piece.startswith("{"):
                    text += piece
                    continue
                name = piece[1:-1]
                value = getattr(made, name)() if hasattr(made, name) else made.other(name)
                if name in _SPANS:
                    inner = value.strip("\"'")
                    spans.append((_SPANS[name], len(text) + value.index(inner), len(text) + value.index(inner) + len(inner)))
                text += value
        out.append((text, spans))
    return out


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(words: list[str]) -> list[tuple[str, ...]]:
    """Features of each word of a text."""
    said = ["NONE", "NONE", *map(says, words), "NONE"]
    out = []
    for k, word in enumerate(words):
        form, size, before, after = shape(word), kind(word), _before(said[k + 1], said[k]), said[k + 3]
        out.append((f"s={form}", f"k={size}", f"p={before}", f"ps={before}+{form}", f"pk={before}+{size}", f"n={after}+{size}"))
    return out


def _examples(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> list[tuple[list[tuple[str, ...]], list[int]]]:
    out = []
    for text, spans in rows:
        places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        labels, last = [], None
        for s, e in places:
            own = next((span for span in spans if s < span[2] and span[1] < e), None)
            labels.append(0 if own is None else LABELS.index(("I-" if own is last else "B-") + own[0]))
            last = own
        out.append((features([text[s:e] for s, e in places]), labels))
    return out


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Start and transition scores: I- only after its own kind."""
    n = len(LABELS)
    start, move = np.zeros(n), np.zeros((n, n))
    for j, label in enumerate(LABELS):
        if label[0] == "I":
            start[j] = -1e4
            for i, before in enumerate(LABELS):
                if before[2:] != label[2:]:
                    move[i, j] = -1e4
    return start, move


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@cache
def trained(steps: int = 150, rate: float = 0.15, decay: float = 2e-4) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Feature numbers, their weights (features x labels) and the transition scores."""
    rows = _examples(labelled())
    names = {f: i for i, f in enumerate(sorted({f for r, _ in rows for x in r for f in x}))}
    n, longest, k = len(rows), max(len(r) for r, _ in rows), len(LABELS)
    index = np.full((n, longest, 6), len(names))
    gold, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (r, labels) in enumerate(rows):
        for t, x in enumerate(r):
            index[i, t], gold[i, t], mask[i, t] = [names[f] for f in x], labels[t], True
    start, fixed = _allowed()
    weights, move = np.zeros((len(names) + 1, k)), np.zeros((k, k))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(move), np.zeros_like(move)]
    one = np.eye(k)
    for step in range(1, steps + 1):
        emit, trans = weights[index].sum(2), move + fixed
        forward, backward = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        forward[:, 0] = emit[:, 0] + start
        for t in range(1, longest):
            new = _lse(forward[:, t - 1, :, None] + trans, 1) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _lse(trans + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        total = _lse(forward[:, -1], 1)
        state = np.exp(np.clip(forward + backward - total[:, None, None], -700, 0)) * mask[..., None]
        change = (one[gold] - state) * mask[..., None]
        by_weight = np.zeros_like(weights)
        for f in range(index.shape[2]):
            np.add.at(by_weight, index[:, :, f].ravel(), change.reshape(-1, k))
        by_weight[-1] = 0
        pair = forward[:, :-1, :, None] + trans + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        both = mask[:, 1:, None, None]
        by_move = (one[gold[:, :-1]][..., None] * one[gold[:, 1:]][:, :, None, :] * both - np.exp(np.clip(pair, -700, 0)) * both).sum((0, 1))
        for grad, value, m, v in ((by_weight / n - decay * weights, weights, 0, 1), (by_move / n - decay * move, move, 2, 3)):
            moments[m] = 0.9 * moments[m] + 0.1 * grad
            moments[v] = 0.99 * moments[v] + 0.01 * grad * grad
            value += rate * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[v] / (1 - 0.99**step)) + 1e-8)
    return names, weights, move + fixed


def viterbi(scores: np.ndarray, which: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The most likely labels of many sequences at once. Each word's scores are a row of `scores`, by `which`;
    the sequences follow each other in it. All go on word by word, the longest first, so that the
    ones that have ended drop out at the end."""
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than t
    out = np.zeros(len(which), np.int8)
    if not longest:
        return out
    n = int(active[0])
    score = scores[which[begins[:n]]] + start
    ended = np.empty(n, np.int64)
    back: list[np.ndarray] = []
    across = np.ascontiguousarray(move.T)
    for t in range(1, longest):
        m = int(active[t])
        if m < n:
            ended[m:n] = score[m:n].argmax(1)
        paths = score[:m, None, :] + across
        best = paths.argmax(2)
        back.append(best.astype(np.int8))
        score = np.take_along_axis(paths, best[:, :, None], 2)[:, :, 0] + scores[which[begins[:m] + t]]
        n = m
    ended[:n] = score.argmax(1)
    now = np.zeros(len(ended), np.int64)
    for t in range(longest - 1, -1, -1):
        m = int(active[t])
        closing = int(active[t + 1]) if t + 1 < longest else 0
        now[closing:m] = ended[closing:m]
        if t + 1 < longest:
            now[:closing] = back[t][np.arange(closing), now[:closing]]
        out[begins[:m] + t] = now[:m]
    return out


class _Field:
    """The trained field as one table of scores, by what the words before and after say and by what a
    word is itself (its shape and kind); and what each word is and says, for words seen so far."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, move: np.ndarray):
        self.move = move
        self.start = _allowed()[0]
        shapes = sorted(n[2:] for n in names if n.startswith("s="))
        kinds = [a + b + q for a in "SML" for b in "mnls" for q in ("", "q")]
        self.own = {(s, k): n for n, (s, k) in enumerate((s, k) for s in [*shapes, None] for k in kinds)}
        self.shapes = set(shapes)
        get = lambda f: weights[names[f]] if f in names else np.zeros(len(LABELS))
        first = np.array([[get(f"s={s}") + get(f"k={k}") + get(f"p={p}") + get(f"ps={p}+{s}") + get(f"pk={p}+{k}") for s, k in self.own] for p in SAYS])
        after = np.array([[get(f"n={a}+{k}") for _, k in self.own] for a in SAYS])
        self.scores = (first[:, None] + after[None]).reshape(-1, len(LABELS)).astype(np.float32)
        self.before = np.array([[SAYS.index(_before(one, two)) for one in SAYS] for two in SAYS], np.int64)
        self.known: dict[bytes, int] = {}

    def look(self, word: bytes) -> int:
        """What a word is, and says."""
        text = word.decode("utf-8", "surrogatepass")
        form = shape(text)
        value = self.own[form if form in self.shapes else None, kind(text)] * len(SAYS) + SAYS.index(says(text))
        if len(word) <= 64:
            if len(self.known) > 400_000:
                self.known.clear()
            self.known[word] = value
        return value

    def labels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Labels of the words of all texts one after the other, and how many words each has."""
        known, look = self.known, self.look
        words, lengths = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = text.encode("utf-8", "surrogatepass").split()
            lengths[k] = len(own)
            words.append(np.fromiter((known[w] if w in known else look(w) for w in own), np.int64, len(own)))
        both = np.concatenate(words) if words else np.zeros(0, np.int64)
        is_, said = both // len(SAYS), both % len(SAYS)
        ends = np.cumsum(lengths)
        first, second, last = (np.zeros(len(both), bool) for _ in range(3))
        some = lengths > 0
        first[(ends - lengths)[some]] = True
        second[(ends - lengths + 1)[lengths > 1]] = True
        last[(ends - 1)[some]] = True
        one = np.where(first, 0, np.roll(said, 1))
        two = np.where(first | second, 0, np.roll(said, 2))
        after = np.where(last, 0, np.roll(said, -1))
        which = (self.before[two, one] * len(SAYS) + after) * len(self.own) + is_
        return viterbi(self.scores, which, lengths, self.move.astype(np.float32), self.start.astype(np.float32)), lengths


_field: list[_Field] = []


def field(model: tuple[dict[str, int], np.ndarray, np.ndarray] | None = None) -> _Field:
    """The field of this process, from a model that is given at first or trained here."""
    if not _field:
        _field.append(_Field(*(model or trained())))
    return _field[0]


#: Words that are decoded at once (or one text, if that has more).
_PART = 200_000

_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base rules, leftmost and without overlap in each kind, in work linear in the text."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:  # a local part runs back from its @, as no local part has one
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _trimmed(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """Without quotes and punctuation around, and for a secret without what names it."""
    if kind == "secret":
        cut = max(text.rfind("=", start, end - 4), text.rfind(":", start, end - 4))
        start = cut + 1 if cut >= 0 else start
    while start < end and text[start] in _STRIP:
        start += 1
    while end > start and text[end - 1] in _STRIP + "()":
        end -= 1
    if kind == "secret":
        while start < end and text[start] in "()":
            start += 1
    return start, end


def find_spans(texts: list[str | None]) -> list[list[tuple[str, int, int, bool]]]:
    """Spans of each text: kind, start, end (code points), and whether a base rule found it."""
    out: list[list[tuple[str, int, int, bool]]] = []
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high] or "") <= 6 * _PART):
            size += len(texts[high] or "")
            high += 1
        out += _spans_of([t or "" for t in texts[low:high]])
        low = high
    return out


def _spans_of(texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    out = [[(*s, True) for s in base_spans(text)] if "@" in text or _DIGIT.search(text) else [] for text in texts]
    labels, lengths = field().labels(texts)
    ends = np.cumsum(lengths)
    for k in np.unique(np.searchsorted(ends, np.flatnonzero(labels), side="right")):
        text, own = texts[k], labels[ends[k] - lengths[k] : ends[k]]
        taken = [(s, e) for _, s, e, _ in out[k]]
        places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        t = 0
        while t < len(own):
            if own[t] == 0:
                t += 1
                continue
            name, first = LABELS[own[t]][2:], t
            t += 1
            while t < len(own) and LABELS[own[t]] == f"I-{name}":
                t += 1
            s, e = _trimmed(text, places[first][0], places[t - 1][1], name)
            if s < e and not any(a < e and s < b for a, b in taken):
                out[k].append((name, s, e, False))
    order = {name: n for n, name in enumerate(BASE_KINDS + ADDED_KINDS)}
    return [sorted(spans, key=lambda s: (order[s[0]], s[1])) for spans in out]


def personal_data(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) and spans: array<struct<kind,start,end,base>> in order
    of kind and start; starts and ends in code points, end exclusive.

    A null or empty text has no spans. Very long texts are read whole, in time linear in
    their length. An added span that overlaps a base one is left out. Rows are independent;
    repeats get equal results, an empty table an empty one. Extra columns pass through; one
    named spans is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    small_batches(docs.sparkSession)
    kind = "array<struct<kind:string,start:int,end:int,base:boolean>>"
    row = F.struct(*[exact(c) for c in keep] or [F.lit(0).alias("_none")]).alias("_row")
    rows = docs.select(row, exact(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(trained())  # a few thousand weights, whatever the input
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field(shared.value)
        for batch in batches:
            found = find_spans(batch.column("_text").to_pylist())
            items = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in own] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(items, spans)], names=["_row", "spans"])

    out = rows.mapInArrow(run, with_row(rows, f"spans {kind}"))
    return out.select(*[F.col("_row")[c].alias(c) for c in keep], "spans")


def op10_shape_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))

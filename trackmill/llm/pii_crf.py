"""Personal data: fixed patterns, and a linear-chain CRF over word shapes.

The patterns give the base spans. The CRF labels every word of every sentence from the shape classes of
the words around it; it is trained by gradient ascent on a small labelled table of this module and
decoded by Viterbi over numpy batches of sentences. It adds ``contact`` spans (spelled-out addresses,
telephone numbers without a plus sign) and ``ident`` spans (numbers of passports, accounts and the
like). A sentence ends at a line's end or at a full stop, unless that belongs to a cue's abbreviation, and
is decoded whole.

Defined results: null text counts as empty and has no spans; texts are searched whole in time linear in
their length; repeated rows give repeated results; an empty table gives an empty one; ids keep their
type, and other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import code_points, keyed_schema, text_input, text_slices

KINDS = ("email", "ip", "card", "phone", "contact", "ident")
#: Words that Viterbi goes through in one piece; results don't depend on it.
PIECE_WORDS = 64
MEMORY_WORDS = 400_000

_LOCAL_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can start inside a run of digits only where the run's start failed, and fails there too.
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(rb"[^0-9]+")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(raw: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: for each @ the run before it, down to the last match or @."""
    floor, at = 0, raw.find(b"@")
    while at >= 0:
        before = raw[floor:at]
        start = floor + len(before.rstrip(_LOCAL_BYTES))
        domain = _DOMAIN.match(raw, at) if start < at else None
        if domain:
            yield start, domain.end()
        floor = domain.end() if domain else at + 1
        at = raw.find(b"@", floor)


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, in bytes, by kind and start."""
    out = [(0, a, b) for a, b in _emails(raw)] if b"@" in raw else []
    for m in _IP.finditer(raw):
        if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(raw):
        if m.end() - m.start() >= 13:
            digits = _DIGITS.sub(b"", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if b"+" in raw:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(raw) if 9 <= len(_DIGITS.sub(b"", m[0])) <= 15]
    return out


# --- word shapes -------------------------------------------------------------------------------

#: Words that lead to or join personal data, by class; compared in lower case without punctuation.
CUES = {
    "call": "phone telephone tel telefon teléfono téléphone mobile cell fax call rufnummer appelez llame handy mobil móvil portable ring telefonnummer handynummer llámame".split(),
    "mail": "mail email e-mail correo courriel kontakt contact write reach".split(),
    "at": "at (at) [at] arroba arobase".split(),
    "dot": "dot (dot) [dot] punkt punto point".split(),
    "number": "ssn passport pasaporte passeport reisepass iban konto account licence license insurance versicherungsnummer dni steuernummer tax reisepassnummer kontonummer".split(),
    "no": "no nr num number numero número numéro nummer id is ist es est".split(),
    "tld": "com org net edu io".split(),
}
#: Cues that are written with a full stop, which then ends no sentence.
ABBREVIATIONS = frozenset(b"tel fax no nr num id ssn iban dni".split())
#: A word of more runs is of one class, as hashes are.
MOST_RUNS = 12
_MARKS = b".,;:!?\"'"
_CUE = {w.encode(): name for name, words in CUES.items() for w in words}
_RUNS = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|[^\x00-\x7f]+|.", re.S)


def shape(word: bytes) -> str:
    """The class of a word: a cue's name, or its runs of digits and letters, digits with their number."""
    core = word.strip(_MARKS)
    cue = _CUE.get(core.lower())
    if cue:
        return cue
    if core.isalpha() or not core.isascii() and not any(48 <= c <= 57 for c in core):
        return "lower" if not core[:1].isupper() else "upper" if core.isupper() and len(core) > 1 else "title"
    if len(core) > 48:
        return "long"
    if _IP.fullmatch(core):
        return "ip"
    out = []
    for run in _RUNS.findall(core.decode("utf-8", "replace")):
        first = run[0]
        out.append(f"d{min(len(run), 17)}" if "0" <= first <= "9" else "A" if "A" <= first <= "Z" else "a" if first.isalpha() else first)
    return "".join(out) if len(out) <= MOST_RUNS else "mixed"


def digits_in(word: bytes) -> int:
    return len(_DIGITS.sub(b"", word))


def _ends(word: bytes) -> bool:
    if word.endswith(b".") and word.strip(_MARKS).lower() in ABBREVIATIONS:
        return False
    return word.endswith((b".", b"!", b"?")) and not word[:-1].endswith(b".")


def _evident(span: bytes, kind: int) -> bool:
    """Whether a span that the CRF found can be what it says: a number in words that all hold digits,
    or for ``contact`` a short run with words for @ and a dot."""
    words = span.split()
    if digits_in(span) >= MANY_DIGITS and all(map(digits_in, words)):
        return True
    return kind == 4 and len(words) <= ADDRESS_WORDS and {"at", "dot"} <= {_CUE.get(w.strip(_MARKS).lower()) for w in words}


# --- the labelled table ------------------------------------------------------------------------

#: One sentence each; {c:...} is contact data, {i:...} an identity number, d a digit, W any word, X a hash.
LABELLED = [
    "call me at {c:(ddd) ddd-dddd} W W", "W W phone {c:ddd-ddd-dddd} W", "tel {c:ddd.ddd.dddd} W W", "W fax : {c:(ddd) ddd-dddd} W", "mobile {c:ddd ddd dddd} W W W",
    "Telefon {c:0ddd dddddd} W W", "telefon {c:0dd dddd dddd} W", "teléfono {c:ddd ddd ddd} W W", "téléphone {c:0d dd dd dd dd} W W", "W W {c:(ddd) ddd-dddd} W W", "W call {c:ddd-dddd} W W",
    "W W {c:W at W dot com} W W", "mail {c:W (at) W (dot) org} W", "write to {c:W dot W at W dot net} W", "W {c:W [at] W [dot] org} W W", "contact {c:W at W dot W dot com} W W", "email W : {c:W arroba W punto com} W",
    "W ssn {i:ddd-dd-dddd} W W", "W W {i:ddd-dd-dddd} W", "passport no {i:Addddddd} W W", "passport number {i:AAdddddd} W", "Reisepass Nr {i:Adddddddd} W W", "W iban {i:AAdd dddd dddd dddd dddd dd} W", "IBAN {i:AAdddddddddddddddddddd} W W",
    "account number {i:dddddddddd} W W", "Konto Nr {i:dddddddd} W", "account no {i:ddddddddd} W W", "DNI {i:ddddddddA} W W", "pasaporte número {i:AAAdddddd} W", "insurance id {i:dddddddddd} W W",
    "reach W W on {c:ddd ddd dddd} W W", "W number is {c:ddd ddd dddd} W", "number is {c:ddd-ddd-dddd} W", "W number is {c:ddd ddd ddd} , W W", "call W al {c:ddd ddd ddd} W", "portable W le {c:0d dd dd dd dd}", "W mobil ist {c:0ddd ddddddd} , W W", "Nummer ist {c:0ddd dddddddd} W", "mobile : {c:0dddddddddd}", "cell : {c:dddddddddd} W", "call W {c:0dddddddddd} W",
    "tel {c:0ddd/dddddd} W", "telefon : {c:0dd/dddddddd} W", "W W {c:ddd.ddd.dddd} W W", "phone W at {c:ddd-ddd-dddd} W", "call W at {c:(ddd) ddd-dddd} W", "fax {c:ddd-dddd} W", "call W on {c:0dddd dddddd} W W",
    "write W to {c:W dot W at W dot com} W", "mail W W to {c:W dot W at W dot W} W", "W is {c:W (at) W (dot) com} , W", "{c:W at W dot com} is W W", "{c:W [at] W [dot] W} W W", "W W {c:W at W dot W} W", "W a {c:W arroba W punto W} W", "W an {c:W at W punkt W} W", "W W to {c:W at W dot com}", "W : {c:W at W dot W dot com}",
    "passport : {i:Addddddd} W", "iban : {i:AAdd dddd dddd dddd dddd dd}", "W : {i:AAdd dddd dddd dddd dddd dddd d}", "iban {i:AAdd dddd dddd dddd dddd dddd dddd} W", "W W {i:AAdd dddd dddd dddd dddd dd} W", "ssn : {i:ddd-dd-dddd}", "W W number {i:ddd-dd-dddd} W", "tax number {i:dd/ddd/ddddd} W", "tax id {i:dd-ddddddd} W", "tax id is {i:ddd ddd ddd} W", "passport W {i:ddAAddddd}", "passport is {i:Addddddd} W W",
    "license {i:Addddddd} W", "license no {i:Addd-dddd-dddd} W", "account is {i:ddddddddd} W", "W account {i:dddddddd} W W", "account : {i:dddddddddddd}", "insurance number {i:AAddddddA} W", "insurance : {i:AAddddddA}", "insurance {i:Addddddddd} W", "DNI : {i:ddddddddA} W", "konto {i:dddddddddd} W",
    "W W is ddd W W", "W number is dd W", "W number ddd W W", "W tax W dd% W", "W tax of dddd W", "account of dddd W", "license W dddd W W", "W at dd dot W", "W W is dddd-dd-dd W", "number dddd of W W", "W at dd dot", "W W dot", "W W dot W W W", "W ring W W", "W W : dd W", "W : W W W", "W W is ddddd W", "W W to W at W W", "W on dd W dddd W", "W le dd W dddd W", "W al dd W W", "call at dd:dd W", "call W W on dddd-dd-dd W",
    "W W W W W W W W W W W W W W W W W W", "W W at W W W W W W, W W on W W W W W at W W", "W at W W W W is W W W W W W W W W W no W W", "W W is W W W W W, W W W at W W W W W W W", "W at W W", "W at W, W W W W W W W W W W W W W W", "W W W W W W W W is W W W es W W W W W W",
    'W W = "X" W W', "W W token = X W W W", '"X" W W', "W : X", "W W X W W", "license , version d.", "W W W W license , version d", "version d. W W", "W%%% dddddddddddddddd### W", "W*** dddddddddddddddd$$$ W***", "W&&& dddddddddddddddd&&& W", "W license version d.d W", "at at at at at at W W W W W W", "at at at at at at at at at W W W", "W W W W at at at at at at at W W W", "about ddddddd W", "W W ddddddd W W", "W dddddd W W W", "W was at dd dot", "W W +d {c:(ddd) ddd-dddd} W W", "W +d {c:(ddd) ddd-dddd} ddd.ddd.ddd.ddd W W", "W. {c:(ddd) ddd-dddd} ddd.dd.ddd.dd W",
    "W it to {c:W dot W at W dot W} W", "W W W {c:W dot W at W dot com} W W", "W W at dd dot W",
    "W at W W W at W W W W", "W W le W W W W le W W W W W W W le W W", "W a W W a W W W W a W W W W W", "W to W W at W W to W W W W W W at W W", "W an W W W an W W W W W an W W", "W W dd W dddd W W W W W W W W", "W dddd , ddd W W W W W W W W", "W W dd W dddd W d.d W", "in dddd , W W W W W W W",
    "W W W W W W W W W W W W write to {c:W at W dot com} W", "W W W W W W W W W W W W W W {c:W at W dot org} W", "W W W W W W W W W W mail {c:W (at) W (dot) net}", "W W W W W W W W W W W W {c:W dot W at W dot com} W", "W W W W W W W W W W W call {c:(ddd) ddd-dddd} W",
    "W W W W W W W W W W W W Konto Nr {i:dddddddd} W", "W W W W W W W W W W W W passport no {i:Addddddd} W", "W W W W W W W W W W W W W W W W W W W W W W", "W, W W W W W W W W, W W W W W W W W W W W W W W",
    "W W no. dddddddd W W", "W no dddddddd W", "W said no. dddddd W W", "W no ddddddd W W", "W W W W W W", "W W , W W W", "W W at W W W", "W W in dddd W W", "W W dd W W", "W d,ddd W W W", "W W dd.dd W W", "W dddd-dddd W W", "W W dd-dd-dddd W", "dddd-dd-dd W W W", "W W dd:dd W W", "W version d.d.d W W",
    "W W d. W W", "W W dd% W W", "W $ddd W W", "W | W | W | W", "W W ddd W ddd W", "W ddd ddd W W", "W W dddddddddddddddd W W", "W W dddddddd W W W", "W W ddddddddddd W", "W W dot W W", "W W at dd W W W", "W point W W is W", "W is W W", "W no W W",
    "W W account W W W", "W the phone W W", "W contact W W W", "W number of W W", "W call W W", "W W A dd W", "W W AAdd W W", "W W dddd W dddd W", "W ISBN ddd-d-dddd-dddd-d W", "W W d-d W W", "W W +d W W", "W W W### W$$$ W%%%",
    "W*** W&&& W$$$ W### W%%% W&&& W### W", "W,%%% W.### W,&&& is&&& W### W*** W", "W*** is W*** W*** W$$$ W", "W&&& W at W%%% W,*** W", "W!! W!! W!! is!! W!!", "W dot W at W W", "W com W W is W", "W es W is es W W", "W=W <W> W_W W", "W/W W;W {W} W", "https://W.W/W W W", "W #dd @W W-W", "W dxd W dA W", "Addd W ddA W", "W dddddddd-dddd-dddd W", "W dd/dd/dddd W",
    "W W at at at at at at", "at at at at W W", "at, at, at, at, W W", "W at at is at at", "W dot dot dot W", "no no no no W", "W call call call W",
]
TAGS = ("O", "B-c", "I-c", "B-i", "I-i")
#: Times each labelled sentence is filled in.
FILLS = 6
#: The share of words outside spans, and of those of many digits anywhere, that training takes for unknown shapes.
UNKNOWN = 0.1
MANY_DIGITS = 5
#: Words of the longest spelled-out address that counts.
ADDRESS_WORDS = 12


def labelled_table(seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """(words, tags) of the labelled sentences, filled with random digits, letters and words."""
    rng = random.Random(seed)

    def word() -> str:
        w = "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 10)))
        return w.title() if rng.random() < 0.25 else w.upper() if rng.random() < 0.03 else w

    def fill(token: str) -> str:
        token = re.sub("W", lambda _: word(), token) if "W" in token else token
        token = token.replace("X", "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(20, 41))))
        if re.fullmatch(r"[^a-ce-zB-Z]*", token):  # made of d, A and signs only
            token = re.sub("[dA]", lambda m: rng.choice("0123456789") if m[0] == "d" else rng.choice("BCDEFG"), token)
        return token

    out = []
    for line in LABELLED * FILLS:
        words, tags = [], []
        for part in re.findall(r"\{[ci]:[^}]*\}|\S+", line):
            held = re.fullmatch(r"\{([ci]):(.*)\}", part)
            for i, token in enumerate((held[2] if held else part).split()):
                words.append(fill(token))
                tags.append(TAGS.index(("I-" if i else "B-") + held[1]) if held else 0)
        if rng.random() < 0.5:
            words[-1] += "."
        out.append((words, tags))
    return out


# --- the model ---------------------------------------------------------------------------------

OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
#: A label that may not follow another: I- only after B- or I- of its kind.
FORBIDDEN = np.array([[t in (2, 4) and s not in (t - 1, t) for t in range(5)] for s in range(5)])


class CRF:
    """Weights of shape classes at offsets around a word, and of label transitions."""

    def __init__(self, shapes: dict[str, int]):
        # 0: outside the sentence, 1: a shape of digits or signs not in the table, 2: such a one of many digits
        self.shapes = shapes
        self.emit = np.zeros((len(OFFSETS), len(shapes) + 3, 5))
        self.move = np.where(FORBIDDEN, -1e4, 0.0)
        self.start = np.array([0, 0, -1e4, 0, -1e4])

    def class_of(self, word: bytes) -> int:
        return self.shapes.get(shape(word)) or 1 + (digits_in(word) >= MANY_DIGITS)

    def classes(self, words: list[str]) -> np.ndarray:
        return np.array([self.class_of(w.encode()) for w in words])

    def scores(self, cls: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Emission of each label for each word; seq: the sentence number of each word."""
        out = self.emit[OFFSETS.index(0)][cls]
        n = len(cls)
        for k, offset in enumerate(OFFSETS):
            if offset and abs(offset) < n:
                a, b = (slice(0, n - offset), slice(offset, n)) if offset > 0 else (slice(-offset, n), slice(0, n + offset))
                near = np.where(seq[a] == seq[b], cls[b], 0)
                out[a] += self.emit[k][near]
        return out

    def train(self, table: list[tuple[list[str], list[int]]], rounds: int = 150, rate: float = 0.1, decay: float = 0.02) -> CRF:
        """Adam on the penalised log-likelihood, by forward-backward over the padded table."""
        longest = max(len(w) for w, _ in table)
        n, pad = len(table), max(abs(o) for o in OFFSETS)
        cls = np.zeros((n, longest + 2 * pad), int)
        tag = np.zeros((n, longest), int)
        size = np.array([len(w) for w, _ in table])
        for i, (words, tags) in enumerate(table):
            cls[i, pad : pad + len(words)] = self.classes(words)
            tag[i, : len(words)] = tags
        many = np.zeros(cls.shape, bool)
        for i, (words, _) in enumerate(table):
            many[i, pad : pad + len(words)] = [digits_in(w.encode()) >= MANY_DIGITS for w in words]
        unknown = np.random.default_rng(3).random(cls.shape) < UNKNOWN
        unknown[:, pad : pad + longest] &= (tag == 0) | many[:, pad : pad + longest]
        cls[unknown & (cls > 0)] = 1
        cls[unknown & many] = 2
        inside = np.arange(longest)[None] < size[:, None]
        near = [cls[:, pad + o : pad + o + longest] for o in OFFSETS]
        state = [np.zeros_like(x) for x in (self.emit, self.move) * 2]
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        gold = np.eye(5)[tag] * inside[..., None]
        gold_move = np.einsum("nts,ntu->su", gold[:, :-1], gold[:, 1:])
        for step in range(1, rounds + 1):
            e = sum(self.emit[k][near[k]] for k in range(len(OFFSETS)))
            fwd, bwd = np.zeros_like(e), np.zeros_like(e)
            fwd[:, 0] = self.start + e[:, 0]
            for t in range(1, longest):
                f = lse(fwd[:, t - 1, :, None] + self.move, 1) + e[:, t]
                fwd[:, t] = np.where(inside[:, t, None], f, fwd[:, t - 1])
            total = lse(fwd[:, -1], 1)
            for t in range(longest - 2, -1, -1):
                b = lse(self.move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
                bwd[:, t] = np.where(inside[:, t + 1, None], b, 0)
            p = np.exp(fwd + bwd - total[:, None, None]) * inside[..., None]
            pair = fwd[:, :-1, :, None] + self.move + (e + bwd)[:, 1:, None, :] - total[:, None, None, None]
            pair = (np.exp(np.minimum(pair, 0)) * inside[:, 1:, None, None]).sum((0, 1))
            excess = (gold - p).reshape(-1, 5)
            by_class = [[np.bincount(near[k].ravel(), excess[:, s], self.emit.shape[1]) for s in range(5)] for k in range(len(OFFSETS))]
            grads = [np.array(by_class).transpose(0, 2, 1), (gold_move - pair) * ~FORBIDDEN - decay * np.where(FORBIDDEN, 0, self.move)]
            grads[0] -= decay * self.emit
            for i, (weight, g) in enumerate(zip((self.emit, self.move), grads, strict=True)):
                state[i] = 0.9 * state[i] + 0.1 * g
                state[i + 2] = 0.99 * state[i + 2] + 0.01 * g * g
                weight += rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 2] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, cls: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Viterbi: the best labels of all words; seq ascends by one from sentence to sentence.

        Sentences are worked out in pieces of ``PIECE_WORDS`` words side by side: a piece that is not its
        sentence's first has one row for each label before it, and the rows are joined afterwards.
        """
        n = len(cls)
        if not n:
            return np.zeros(0, np.int8)
        e = self.scores(cls, seq).astype(np.float32)
        move = self.move.astype(np.float32)
        head = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        pieces = -(-np.diff(np.r_[head, n]) // PIECE_WORDS)
        place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)  # in its sentence
        first = np.repeat(head, pieces) + place * PIECE_WORDS
        copies = np.where(place > 0, 5, 1)
        row = np.cumsum(copies) - copies  # the first row of each piece
        begin, size = np.repeat(first, copies), np.repeat(np.diff(np.r_[first, n]), copies)
        before = np.arange(len(begin)) - np.repeat(row, copies)
        best = np.where(np.repeat(place > 0, copies)[:, None], move[before], self.start.astype(np.float32)) + e[begin]
        order = np.argsort(-size, kind="stable")
        best, begin, size = best[order], begin[order], size[order]
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        longest = int(size[0])
        live = np.searchsorted(-size, -np.arange(longest), "left")  # rows longer than t
        back = []
        for t in range(1, longest):
            m = live[t]
            prev = best[:m]
            top, arg = prev[:, 0:1] + move[0], np.zeros((m, 5), np.int8)
            for s in range(1, 5):
                other = prev[:, s : s + 1] + move[s]
                over = other > top
                top = np.where(over, other, top)
                arg[over] = s
            best[:m] = top + e[begin[:m] + t]
            back.append(arg)
        chosen, last = self._joined(best[rank], row, pieces)
        chosen = rank[chosen]
        by_size = np.argsort(chosen)
        chosen, at = chosen[by_size], last[by_size]
        out = np.zeros(n, np.int8)
        for t in range(longest - 1, 0, -1):
            m = int(np.searchsorted(chosen, live[t]))
            out[begin[chosen[:m]] + t] = at[:m]
            at[:m] = back[t - 1][chosen[:m], at[:m]]
        out[begin[chosen]] = at
        return out

    @staticmethod
    def _joined(best: np.ndarray, row: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row and the last label of each piece on its sentence's best path."""
        offset = np.cumsum(pieces) - pieces
        order = np.argsort(-pieces, kind="stable")
        offset, pieces = offset[order], pieces[order]
        total = best[row[offset]].astype(np.float64)
        came = []
        for k in range(1, int(pieces[0])):
            m = int(np.searchsorted(-pieces, -k, "left"))  # sentences of more than k pieces
            paths = total[:m, :, None] + best[row[offset[:m] + k][:, None] + np.arange(5)]
            came.append(paths.argmax(1).astype(np.int8))
            total[:m] = paths.max(1)
        last = np.zeros(len(row), np.int8)
        chosen = row.copy()
        at = total.argmax(1).astype(np.int8)
        for k in range(int(pieces[0]) - 1, 0, -1):
            m = len(came[k - 1])
            piece = offset[:m] + k
            last[piece] = at[:m]
            at[:m] = came[k - 1][np.arange(m), at[:m]]
            chosen[piece] += at[:m]
        last[offset] = at
        return chosen, last


def trained(seed: int = 7) -> CRF:
    table = labelled_table(seed)
    shapes = sorted({shape(w.encode()) for words, _ in table for w in words})
    return CRF({s: i + 3 for i, s in enumerate(shapes)}).train(table)


# --- whole texts -------------------------------------------------------------------------------


class Finder:
    def __init__(self, model: CRF):
        self.model = model
        self.known: dict[bytes, int] = {}

    def _classes(self, words: list[bytes]) -> np.ndarray:
        """Shape class times two, plus one where the word ends a sentence."""
        if len(self.known) > MEMORY_WORDS:
            self.known = {}
        known = self.known
        new = [w for w in set(words) if w not in known]
        for w in new:
            known[w] = 2 * self.model.class_of(w) + _ends(w)
        out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        for w in new:
            if len(w) > 100:
                del known[w]
        return out

    def learned(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) in bytes that the CRF finds in each text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        raw = b"\n".join(texts)
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            return out
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.r_[True, space, True].view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return out
        coded = self._classes(raw.split())
        cls, stop = coded >> 1, (coded & 1).astype(bool)
        lines = np.searchsorted(np.flatnonzero(data == 10), starts)
        new = np.r_[True, (lines[1:] != lines[:-1]) | stop[:-1]]
        label = self.model.decode(cls, np.cumsum(new) - 1)
        hit = np.flatnonzero(label)
        if len(hit):
            begin = np.isin(label[hit], (1, 3)) | np.r_[True, (np.diff(hit) != 1)] | new[hit]
            a = np.flatnonzero(begin)
            b = np.r_[a[1:], len(hit)] - 1
            base = np.cumsum([0, *(len(t) + 1 for t in texts)])
            for x, y in zip(hit[a].tolist(), hit[b].tolist(), strict=True):
                s, e = int(starts[x]), int(ends[y])
                while e - s > 1 and raw[e - 1] in _MARKS:
                    e -= 1
                while e - s > 1 and raw[s] in b",;:!?\"'":
                    s += 1
                if not _evident(raw[s:e], 4 if label[x] in (1, 2) else 5):
                    continue
                d = int(np.searchsorted(base, s, "right")) - 1
                out[d].append((4 if label[x] in (1, 2) else 5, s - int(base[d]), e - int(base[d])))
        return out

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """All spans of each text by kind and start; learned ones that touch a base span are left out."""
        found = []
        for raw, more in zip(texts, self.learned(texts), strict=True):
            base = base_spans(raw)
            starts, reach = [], []  # of the base spans by start; the furthest end up to each
            for a, b in sorted((a, b) for _, a, b in base) if more else ():
                starts.append(a)
                reach.append(max(b, reach[-1]) if reach else b)
            free = (m for m in more if not (at := bisect_left(starts, m[2])) or reach[at - 1] <= m[1])
            found.append(base + sorted(free))
        return found


@lru_cache(1)
def default_model() -> CRF:
    return trained()


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", model: CRF | None = None) -> DataFrame:
    """Per document: key, a count per kind, base_sha256, spans (kind:start:end by kind, then start,
    comma-joined; code points)."""
    model = model or default_model()
    narrow, texts_of = text_input(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for batch in batches:
            texts = list(text_slices(texts_of(batch)))
            counts, shas, joined = [[] for _ in KINDS], [], []
            for raw, spans in zip(texts, finder.spans(texts), strict=True):
                points = code_points(raw, [x for _, s, e in spans for x in (s, e)])
                names = [(k, f"{KINDS[k]}:{a}:{b}") for (k, _, _), a, b in zip(spans, points[::2], points[1::2], strict=True)]
                for i, c in enumerate(counts):
                    c.append(sum(k == i for k, _ in names))
                shas.append(hashlib.sha256(",".join(n for k, n in names if k < 4).encode()).hexdigest())
                joined.append(",".join(n for _, n in names))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(joined, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = keyed_schema(narrow, ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
    return narrow.mapInArrow(run, schema)


def pii_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_contact, n_ident of every document."""
    return find(docs).select(F.col("key").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_contact", "n_ident")

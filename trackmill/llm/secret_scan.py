"""Secret scanning: fixed patterns, and strings in sensitive places that do not compress.

Three patterns give the base spans. Beyond them, every string of twelve signs or more near a sensitive
word, before or after it and on whatever line, or in the place of a password in an address, is measured in
two ways. A zstandard compressor primed with a dictionary of identifiers compresses the text around it with
and without the string, and the marginal bytes per byte of the string say how new it is to both. And what
it costs to spell it as a name is set against its signs being drawn at random: its parts, cut at signs,
digits and changes of case, are spelled letter by letter after the two before, by the frequencies of three
letters in the identifiers or those in the whole corpus, whichever knows the part better. Names and words,
also such as no list holds, are cheap by one of the measures; keys by neither, and are reported as
``novel``. A reported string makes the place after it sensitive as well, so that a key of many lines is
found whole.

Defined results: null text counts as empty and has no spans; texts are scanned whole whatever their
length, in time linear in it; repeated rows give repeated results; an empty table gives an empty one;
ids keep their type; other columns, whatever their names, are not read, or are handed on unchanged. Strings
without a letter are no keys.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.llm.common import code_points, keyed_schema, text_input, text_slices, unpacked, whole_rows

KINDS = ("assign", "access", "hex", "novel")
LEAST = {"assign": 6, "access": 20}
#: On lower-cased bytes; A-Z only are lowered, and no offset moves.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")

#: On the text as it is, since a change of case begins a word.
SENSITIVE = re.compile(
    rb"(?:(?<![A-Za-z])auth|Auth|(?<![A-Z])AUTH)(?:[oO][rR][iI][zZsS]\w*|[eE][nN][tT][iI][cC][aA][tT]\w*)?(?![a-z])"
    rb"|(?:(?<![A-Za-z])(?:pwd|bearer)|Pwd|Bearer|PWD|BEARER)(?![a-z])|(?:secret|Secret|SECRET)(?!ar|ion|AR|ION)|(?:token|Token|TOKEN)(?!i[sz]|IZ)"
    rb"|(?i:credential|passphrase|private.?key|session.?id|signature|passw|api.?key|access.?key|encryption.?key)"
    rb"|://[^\s/:@]*:(?=[^\s/@]+@)"
)
#: One of these is in every match, in lower case.
HINTS = (b"auth", b"pwd", b"bearer", b"secret", b"token", b"credential", b"passphrase", b"private", b"session", b"signature", b"passw", b"key", b"://")
VALUE = re.compile(rb"[A-Za-z0-9+/_=!@#$%^&*~?-]{12,}")
LETTERS = re.compile(rb"[A-Za-z]")
#: One side of an equals sign in a run; signs at the end are padding.
PART = re.compile(rb"=*[^=]+(?:=+(?![^=]))?")
#: Before the host of an address.
HOST = re.compile(rb"@[a-z0-9-]*\Z")
#: Parts of a name.
NAME_PART = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^A-Za-z0-9]")
#: Between the lines of a wrapped string, which is measured as one first.
WRAP = re.compile(rb"\x20*\r?\n[\x20\t]*")
#: A run is measured within so many bytes before or after a sensitive word or after a reported value.
REACH = 128
LEAST_VALUE = 12
CONTEXT_BYTES = 512
#: Marginal compressed bytes per byte from which a candidate is reported, beyond the bytes that any string
#: costs, whatever its length.
NOVELTY, STRING_BYTES = 0.66, 2
#: Bits that begin a part of a name, after a sign that joins parts and elsewhere; bits of a sign that does not.
JOINED, UNJOINED, SIGN = 1.0, 4.0, 6.0
#: Bits a sign by which a spelling as a name must be dearer than signs at random.
STRANGE = 0.0
#: Words that identifiers are made of; the dictionary holds them in the usual joined forms.
IDENTIFIER_WORDS = """
access account action active add address admin alias allow api app application array async auth author authorization
backend base64 bearer binary block body bool branch bucket buffer build byte cache call certificate channel check
child class client close cloud code column command commit config connection const content context control cookie copy
count create credential current data database date debug default delete description dev device dict digest directory
disk document domain download driver email enable encode end endpoint engine entry env environment error event example
execute export false field file filter find float format frame from function get global graph group handler hash header
host html http https id image import index info init input insert instance int integer interface item job json key label
language last length level library limit line link list load local log login main manager map max memory merge message
meta method min mode model module name namespace network new next node null number object offset open option order
output owner package page parameter parent parse password path pattern payload policy pool port prefix print private
process product profile project property protocol provider proxy public publish query queue random range read record
redirect refresh region register release remote remove render repository request require reset resource response result
return role root route run sample save schema scope script search secret section secure select self send server service
session set settings shared sign signature size socket sort source split stack start state static status stop storage
store stream string style submit suffix sync system table tag target task team temp template test text thread time
timeout title token trace transaction true type unique update upload url user username util uuid value variable vector
verify version view volume web width window worker write xml yaml zone
""".split()


def identifier_dictionary() -> bytes:
    """Raw content for the compressor: every word alone, in capitals, and joined with its neighbours."""
    words = IDENTIFIER_WORDS
    pairs = list(zip(words, words[1:] + words[:1], strict=True))
    forms = [" ".join(words), " ".join(w.upper() for w in words), " ".join(f"{a}_{b}" for a, b in pairs), " ".join(a + b.title() for a, b in pairs)]
    return "\n".join(forms).encode()


def letter_codes(raw: bytes) -> np.ndarray:
    """1 to 26 for letters in either case, 0 for all other bytes."""
    low = np.frombuffer(raw, np.uint8) | 32
    return np.where((low >= 97) & (low <= 122), low - 96, 0).astype(np.int64)


def triples(raw: bytes) -> np.ndarray:
    """How often each three letters follow each other, with 0 for what is no letter."""
    c = letter_codes(raw)
    return np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)


def letter_counts(docs: DataFrame, text: str | None = "text") -> np.ndarray:
    """``triples`` of all texts, each between blanks: a table of fixed size."""
    narrow = docs.select(F.col(text) if text else F.col("row.text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            total += triples(b"  " + b"  ".join(text_slices(batch.column(0))) + b"  ")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["triple", "n"])

    out = np.zeros(27**3, np.int64)
    for triple, n in narrow.mapInArrow(run, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect():  # at most 27 ** 3 rows
        out[triple] = n
    return out


class Spelling:
    """Bits of a letter after the two before it, backing off to one and none."""

    def __init__(self, counts: np.ndarray):
        t = counts.reshape(27, 27, 27).astype(float)
        t[:, :, 0] = 0
        two = t.sum(0)
        one = two.sum(0)
        p1 = (one + 1) / (one.sum() + 27)
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        self.bits = -np.log2((t + 5 * p2) / (t.sum(2, keepdims=True) + 5))

    def cost(self, word: bytes) -> float:
        c = np.r_[0, 0, letter_codes(word)]
        return float(self.bits[c[:-2], c[1:-1], c[2:]].sum())


class Scanner:
    def __init__(self, counts: np.ndarray | None = None, novelty: float = NOVELTY):
        """counts: the corpus' ``letter_counts``."""
        import zstandard

        words = triples(("  " + "  ".join(IDENTIFIER_WORDS) + "  ").encode())
        self.spellings = [Spelling(words)] + ([] if counts is None or not counts.any() else [Spelling(counts)])

        primed = zstandard.ZstdCompressionDict(identifier_dictionary(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.novelty = novelty

    def marginal(self, raw: bytes, start: int, end: int, after: int = CONTEXT_BYTES // 2) -> float:
        """Compressed bytes that raw[start:end] adds to its surroundings, less those of any string, per byte."""
        around = raw[end : end + after] + b"\n" + raw[max(0, start - CONTEXT_BYTES) : start]
        size = lambda x: len(self.compressor.compress(x))
        return (size(around + raw[start:end]) - size(around) - STRING_BYTES) / (end - start)

    def strangeness(self, value: bytes) -> float:
        """Bits a sign by which spelling a string as a name costs more than drawing its signs at random from
        the kinds of signs that it has."""
        kinds = ((b"abcdefghijklmnopqrstuvwxyz", 26), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26), (b"0123456789", 10), (b"+/_=!@#$%^&*~?-", 15))
        size = sum(n for signs, n in kinds if value.strip(b"=") and any(c in signs for c in value))
        chance, name, joined = len(value) * math.log2(max(size, 2)), 0.0, True
        for part in NAME_PART.findall(value):
            if part[:1].isalpha():
                name += (JOINED if joined else UNJOINED) + min(s.cost(part) for s in self.spellings)
                joined = False
            elif part[:1].isdigit():
                name += UNJOINED + len(part) * math.log2(10)
                joined = False
            else:
                joined = part in (b"_", b"-", b"/")
                name += JOINED if joined else SIGN
        return (name - chance) / len(value)

    def spans(self, raw: bytes) -> list[tuple[int, int, int, int, int]]:
        """(start, kind, end, value start, value end) in bytes, sorted by start, then kind."""
        lowered = raw.lower()
        out = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(lowered) if m.end(2) - m.start(2) >= LEAST["assign"]]
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST["access"]]
        out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(raw)]
        out.sort()
        return sorted(out + self._novel(raw, out)) if any(h in lowered for h in HINTS) else out

    def _novel(self, raw: bytes, base: list) -> list[tuple[int, int, int, int, int]]:
        masked = bytearray(raw)
        for s, _, e, *_ in base:
            masked[s:e] = b"\0" * (e - s)
        words = [m.span() for m in SENSITIVE.finditer(raw)]
        if not words:
            return []
        ends = [e for _, e in words]
        blocks: list[list[tuple[int, int]]] = []
        for run in VALUE.finditer(masked):
            if blocks and WRAP.fullmatch(masked, blocks[-1][-1][1], run.start()):
                blocks[-1].append(run.span())
            else:
                blocks.append([run.span()])
        out, last, seen = [], -REACH - 1, set()
        for block in blocks:
            start, end = block[0][0], block[-1][1]
            first = bisect_left(ends, start - REACH)
            if start > last + REACH and (first == len(words) or words[first][0] > end + REACH):
                continue
            whole = len(block) > 1 and self._new(raw, start, end, seen)
            for a, b in block:
                inside = words[bisect_left(ends, a) : bisect_left(ends, b + 1)]
                for s, e in [(a, b)] if whole else self._values(raw, a, b, sorted({x for w in inside for x in w}), seen):
                    s += len(raw[s:e]) - len(raw[s:e].lstrip(b"="))
                    seen.add(raw[s:e])
                    out.append((s, 3, e, s, e))
                    last = e
        return out

    def _new(self, raw: bytes, start: int, end: int, seen: set[bytes]) -> bool:
        """Whether a string was reported before, or is no name and new to the text on both sides, or to that
        before it.

        What follows is left out in a second look, as a compressor may first find it worth coding with
        the string, which makes the string look cheap.
        """
        value = raw[start:end]
        if len(value) < LEAST_VALUE or not LETTERS.search(value):
            return False
        if value.lstrip(b"=") in seen:
            return True
        if self.strangeness(value) < STRANGE:
            return False
        return self.marginal(raw, start, end) >= self.novelty or self.marginal(raw, start, end, after=0) >= self.novelty

    def _values(self, raw: bytes, start: int, end: int, words: list[int], seen: set[bytes]) -> list[tuple[int, int]]:
        """The novel parts of a run: its sides of equals signs, else what lies between sensitive words
        (``words`` holds their bounds), else the run as one."""
        out = []
        if raw[max(0, start - 1) : start] == b":" and start in words:  # the password of an address, before its host
            host = HOST.search(raw, start, end)
            end = host.start() if host else end
        for part in PART.finditer(raw, start, end):
            a, b = part.span()
            cuts = [a, *words[bisect_right(words, a) : bisect_left(words, b)], b]
            if self._new(raw, a, b, seen):
                out.append((a, b))
            elif len(cuts) > 2:
                out += [(x, y) for x, y in pairwise(cuts) if self._new(raw, x, y, seen)]
        return out or ([(start, end)] if self._new(raw, start, end, seen) else [])


def scan(docs: DataFrame, key: str = "doc_id", text: str | None = "text", novelty: float = NOVELTY) -> DataFrame:
    """Per document: key, n_assign, n_access, n_hex, n_novel, base_sha256, spans (kind:start:end by
    start, then kind, comma-joined; code points), redacted (the text without the values)."""
    narrow, texts_of = text_input(docs, key, text)
    letters = letter_counts(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(letters, novelty)
        for batch in batches:
            counts, shas, joined, cleaned = [[], [], [], []], [], [], []
            for raw in text_slices(texts_of(batch)):
                spans = scanner.spans(raw)
                points = code_points(raw, [x for s, _, e, *_ in spans for x in (s, e)])
                names = [(k, f"{KINDS[k]}:{a}:{b}") for (_, k, *_), a, b in zip(spans, points[::2], points[1::2], strict=True)]
                for i, c in enumerate(counts):
                    c.append(sum(k == i for k, _ in names))
                shas.append(hashlib.sha256(",".join(n for k, n in names if k < 3).encode()).hexdigest())
                joined.append(",".join(n for _, n in names))
                cleaned.append(redact(raw, [(a, b) for *_, a, b in spans]).decode() if spans else None)
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(x, pa.string()) for x in (shas, joined, cleaned))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "redacted"])

    schema = keyed_schema(narrow, "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, redacted string")
    return narrow.mapInArrow(run, schema)


def redact(raw: bytes, values: list[tuple[int, int]], mark: bytes = b"[SECRET]") -> bytes:
    """raw with each value, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for a, b in sorted(values):
        if a >= at:
            out += [raw[at:a], mark]
        at = max(at, b)
    return b"".join([*out, raw[at:]])


def secrets_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel of every document."""
    return scan(docs).select(F.col("key").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same rows with the values of all spans replaced; n_chars follows a changed text."""
    found = scan(whole_rows(docs), key="row", text=None)
    columns = dict(zip(docs.columns, unpacked(found, docs, "key"), strict=True))
    columns["text"] = F.coalesce("redacted", "key.text").alias("text")
    if "n_chars" in columns:
        size = F.char_length("redacted").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("redacted").isNotNull(), size).otherwise(F.col("key.n_chars")).alias("n_chars")
    return found.select(*columns.values())

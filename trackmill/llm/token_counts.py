"""Token counts with a whole-token shortcut.

The vocabulary is examined once, offline: no piece holds the space mark after another character, so a
merge never crosses from one word into the next space, and a text's count is the sum over its words,
each with the spaces before it. Vocabulary strings that encode alone as one token are proved by
encoding them; words equal to one of them count 1 without any merge. Other words are merged by the
library, once per task while the bounded memory of words lasts.

Defined results: null text counts as empty, with no bytes and no tokens; a text of any length is
counted whole; repeated rows give repeated results; an empty table gives an empty one; ids keep their type,
and other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trackmill.llm.common import keyed_schema, text_input, text_slices

LIMIT = 4096
#: Words remembered by a task besides the vocabulary's own; all are forgotten when it is full.
MEMORY_WORDS = 400_000
#: Words longer than this are not remembered.
LONG_WORD = 200
MARK = "▁"
WORDS = re.compile(" *[^ ]+| +")


class PieceCounter:
    """Counts the tokens of texts for a sentencepiece BPE file with the identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.encode("a  b \n") != self.model.encode("a b")
        starts = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        alone = self.model.encode(starts, num_threads=1)
        #: A word after one space, or at the start, is looked up without that space.
        self.whole = {w: 1 for w, ids in zip(starts, alone, strict=True) if len(ids) == 1}
        self.whole[""] = 1  # a last space alone: the mark itself
        self.counts = dict(self.whole)

    def count_batch(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [len(self.model.encode(t, num_threads=1)) for t in texts]
        split = [self._words(t) for t in texts]
        counts = self.counts
        new = list({w for words in split for w in words if w not in counts})
        if new and len(counts) > MEMORY_WORDS:
            counts = self.counts = dict(self.whole)
            new = list({w for words in split for w in words if w not in counts})
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            counts.update(zip(part, map(len, self.model.encode(part, num_threads=1)), strict=True))
        out = [sum(map(counts.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > LONG_WORD:
                del counts[w]
        return out

    @staticmethod
    def _words(text: str) -> list[str]:
        """Each word with the spaces before it but one; the encoder puts that one back."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in WORDS.findall(" " + text)]
        return text.split(" ")


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document: key, n_bytes, n_tokens, over_limit."""
    narrow, texts_of = text_input(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(path)
        for batch in batches:
            sizes, counts = [], []
            held, size = [], 0
            for raw in text_slices(texts_of(batch)):
                sizes.append(len(raw))
                held.append(raw.decode())
                size += len(raw)
                if size > 2 << 20:
                    counts += counter.count_batch(held)
                    held, size = [], 0
            counts += counter.count_batch(held)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_bytes", "n_tokens", "over_limit"])

    return narrow.mapInArrow(run, keyed_schema(narrow, "n_bytes long, n_tokens long, over_limit boolean"))

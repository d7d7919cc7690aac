import random

import public_tokenizers
import pytest
import sentencepiece

from trackmill.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(df, model):
    want = []
    for r in df.collect():
        text = r.text or ""
        n = len(model.encode(text))
        want.append((str(r.doc_id), len(text.encode()), n, n > 4096))
    assert sorted((str(r[0]), *r[1:]) for r in T.token_counts(df, PATH).collect()) == sorted(want)


def test_edge_rows(edge_docs, model):
    check(edge_docs, model)


def test_real_rows(real_docs, model):
    check(real_docs, model)


def test_empty_table(no_docs):
    assert T.token_counts(no_docs, PATH).collect() == []


def test_random_strings_and_small_memory(model, monkeypatch):
    monkeypatch.setattr(T, "MEMORY_WORDS", 10)
    monkeypatch.setattr(T, "LONG_WORD", 6)
    rng = random.Random(4)
    parts = [" ", "  ", "▁", "\n", "a", "the", "é", "<s>", "</s>", "<unk>", "<0x0A>", "漢", "\x00", ".", "tion", "    "]
    counter = T.PieceCounter(PATH)
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(20)]
        assert counter.count_batch(texts) == [len(model.encode(t)) for t in texts]


def test_shortcut_words_are_single_tokens(model):
    counter = T.PieceCounter(PATH)
    assert counter.by_word and len(counter.whole) > 10_000
    assert all(len(model.encode(w)) == 1 for w in list(counter.whole)[:500] if w)

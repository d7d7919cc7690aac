import hashlib
import random
import struct
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trackmill.llm import bpe_codec as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()

    def row(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    return row


def check(df, plain):
    want = sorted((str(r.doc_id), *plain(r.text)) for r in df.collect())
    assert sorted((str(r[0]), *r[1:4]) for r in B.codec_table(df, PATH).collect()) == want


def test_edge_rows(edge_docs, plain):
    check(edge_docs, plain)


def test_real_rows(real_docs, plain):
    check(real_docs, plain)


def test_empty_table(no_docs):
    assert B.codec_table(no_docs, PATH).collect() == []


def test_outputs_round_trip(real_docs):
    got = B.encoded(real_docs, PATH).collect()
    texts = {r.doc_id: r.text for r in real_docs.collect()}
    assert all(r.decoded == texts[r.key] and len(r.ids) == r.n_tokens for r in got)


def test_random_strings(plain):
    import numpy as np

    rng = random.Random(3)
    parts = ["'s", " ", "  ", "\n", "a", "é", "Z", "7", "<|endoftext|>", "'re", "_", "漢", "\t", " the", "ll", "<|endof"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(400))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    codec = B.ChunkCodec(PATH)
    for text, (ids, back) in zip(texts, codec.encode_batch(b"".join(raw), offsets), strict=True):
        n, ids_sha, back_sha = plain(text)
        assert (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()) == (n, ids_sha, back_sha)


def test_shared_chunks_are_encoded_once_and_joins_repaired(plain):
    import numpy as np

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(3000))
    texts = [f"{rng.choice(words)} " * rng.randrange(30) + passage + f" {i}" for i in range(6)]
    codec = B.ChunkCodec(PATH)
    raw = [t.encode() for t in texts]
    got = list(codec.encode_batch(b"".join(raw), np.cumsum([0, *map(len, raw)])))
    for text, (ids, back) in zip(texts, got, strict=True):
        n, ids_sha, back_sha = plain(text)
        assert (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()) == (n, ids_sha, back_sha)
    c = codec.counts
    assert c["chunks"] > 6 * 30 and c["encoded"] < c["chunks"] / 3  # the passage's chunks are those of the first text
    assert c["joins"] > 6 * 30 and c["repaired"] == c["joins"] and c["whole"] == 0
    joined = np.concatenate([B.ChunkCodec(PATH)._encode([p])[0] for p in chunks_of(raw[0])])
    assert joined.tolist() != np.frombuffer(got[0][0], "<u4").tolist()  # without repairs the ids would be wrong


def chunks_of(raw):
    import numpy as np

    edges = B.chunk_bounds(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist()
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def test_a_window_that_does_not_agree_has_its_text_encoded_whole(plain, monkeypatch):
    import numpy as np

    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(2000))
    monkeypatch.setattr(B, "breaks", lambda data: np.arange(1, len(data)))  # breaks where there are none
    codec = B.ChunkCodec(PATH)
    chunk = B.Chunk
    monkeypatch.setattr(B, "Chunk", lambda piece, ids, at, own: chunk(piece, ids, at, own) if token_ends(own, ids) >= set(at) else broken(chunk, piece, own))
    (ids, _), = codec.encode_batch(text.encode(), np.array([0, len(text)]))
    assert codec.counts["whole"] == 1 and len(ids) // 4 == plain(text)[0] and hashlib.sha256(ids).hexdigest() == plain(text)[1]


def token_ends(codec, ids):
    out, at = set(), 0
    for i in ids:
        at += codec.sizes[i]
        out.add(at)
    return out


def broken(chunk, piece, codec):
    """A chunk whose ids to agree on are none that a window has."""
    out = object.__new__(chunk)
    out.head, out.tail, out.first, out.last, (out.ids, out.back) = piece[:8], piece[-8:], (1, 1, 1), (2, 2, 2), codec.result([])
    return out


def test_breaks_are_where_the_library_breaks():
    """Text before and after a break encodes on its own as in the whole."""
    import numpy as np

    t = Tokenizer.from_file(PATH)
    rng = random.Random(9)
    parts = ["a", "é", "漢", "ñ", "ж", "7", ".", "'s", "'", " ", "  ", "\n", "\t", "\u3000", "\u00a0", "\u2003", "\x85", "😀", "<|endoftext|>", "\x1f"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(2, 25)))
        raw, ids = text.encode(), t.encode(text, add_special_tokens=False).ids
        for at in B.breaks(np.frombuffer(raw, np.uint8)).tolist():
            a, b = raw[:at].decode(), raw[at:].decode()
            assert t.encode(a, add_special_tokens=False).ids + t.encode(b, add_special_tokens=False).ids == ids, (text, at)


def test_a_large_batch_takes_the_memory_of_a_slice(plain):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(rng.choices(letters, k=6)) for _ in range(600)) for _ in range(1200)]
    raw = "".join(texts).encode()
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    own = B.codec(PATH)
    own.forget()
    tracemalloc.start()
    try:
        found = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()) for i, d in own.encode_batch(raw, offsets)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 * len(raw)
    own.forget()
    assert not own.chunks and not own.windows and not own.held
    assert found[::100] == [plain(t) for t in texts[::100]]

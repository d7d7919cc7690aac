import pytest

#: Texts at the edges: null, empty, blank, one word, ties, marks, other scripts, very long.
EDGE = [
    None, "", " ", "  ", "a", "a b", "A b", " lead", "trail ", "x  y   z", "tab\tnew\nline\r\n", "Ünï cödé ñ 漢字 ▁ mark", "<|endoftext|> in <|endoftext|>text",
    "don't we'll I'm it's 'st", "    　", "😀 emoji 😀😀", "0123456789" * 30, "long " * 30000, "nospace" * 9000, "same text", "same text", "\x00 nul \x00",
]


@pytest.fixture(scope="session")
def edge_texts():
    return EDGE


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge texts with a null and repeated ids, and columns whose names operators use inside."""
    rows = [(i, t, "x", 7, "k", "fp") for i, t in enumerate(EDGE)] + [(None, "no id", "x", 7, "k", "fp"), (3, "  ", "x", 7, "k", "fp")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, key string, fp string").repartition(3)


@pytest.fixture(scope="session")
def real_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)

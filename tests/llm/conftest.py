import random

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(40_000))
#: Null, empty, blank, one word, long, equal and odd texts.
TEXTS = [None, "", "   \n\t", "one", LONG, "same text here", "same text here", "Ünï çödé ﬁ​ \x1c x\ny  z\r\n", "🙂🙂 👩‍👩‍👧 ́combining", "<|endoftext|> a <|startoftext|>b"]


def prose(r: random.Random, words: int, vocabulary: int = 5000) -> str:
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with every odd text, a null id, a repeated row, null columns, and columns whose names operators use inside."""
    rows = [(i, t, "en", "s", None, i, i, "x", i) for i, t in enumerate(TEXTS)]
    rows += [(None, "text without id", None, None, 3, 1, 1, "y", 1), rows[5], (7, "another text under a used id", "de", None, None, 0, 0, "z", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, t long, shard string, score long")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path

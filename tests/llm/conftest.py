import random

import pytest

WORDS = "the of and to in supply works tender clause bridge road concrete steel water party notice period engineer measure material quality report weekly schedule payment contract design survey drawing foundation column girder cement sand".split()


@pytest.fixture
def prose():
    def make(seed: int, n: int = 60) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", str(rng.randint(0, 9))]) for _ in range(n)) + "."

    return make


#: Columns that clash with names the operators use inside or return.
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fingerprint string, ids string, label int, path string, x string, id string, row string, value string"


@pytest.fixture
def docs(spark):
    def make(rows):
        """``(doc_id, text)`` or ``(doc_id, text, lang)`` rows with many other columns."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None if r[0] is None else f"src{r[0] % 3}", None, 0.5, "f", "i", 1, "p", "x", "z", "r", "v") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd(prose):
    """Null and empty texts, white space, repeats, a null id, a very long text, other scripts."""
    return [(1, None), (2, ""), (3, "  \n\t "), (4, prose(4)), (5, prose(4)), (4, prose(4)), (None, prose(9)), (6, "é ß ñ 漢字 🙂  x"), (7, prose(7, 30_000)), (8, "a"), (9, "!!! ???")]

import random

import pytest

from clausewright.llm import decontaminate


@pytest.mark.parametrize("length", [1, 2, 4, 7, 12, 40, 100, 400, 1000])
def test_items_of_every_length_are_found(spark, docs, length):
    """An item whose words are as rare as those around it, contained verbatim."""
    rng = random.Random(length)
    word = lambda: f"w{rng.randrange(20_000)}x"
    some = lambda n: " ".join(word() for _ in range(n))
    item = some(length)
    rows = [(k, some(200)) for k in range(20)] + [(100 + k, f"{some(61 + 5 * k)} {item} {some(67)}") for k in range(6)]
    bench = spark.createDataFrame([(1, item), (2, some(30))], "item_id bigint, text string")
    got = decontaminate.matches(docs(rows), bench).collect()
    found = {r["doc_id"] for r in got if r["item_id"] == 1}
    assert {100 + k for k in range(6)} <= found
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    if length > 2:
        assert found == {100 + k for k in range(6)}
        assert {r["doc_id"] for r in decontaminate.remove_contaminated(docs(rows), bench).collect()} == set(range(20))

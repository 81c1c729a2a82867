"""What the pipeline's near-duplicate stage keeps where doc_id is null or names several texts."""

import pytest

A, B, C, D, E = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcde")


@pytest.mark.parametrize("repeats", [False, True])
def test_ids_that_are_null_or_shared(spark, repeats):
    from groundwire.llm.near_dup import one_of_each

    rows = [(None, A, "p"), (None, B, "q"), (None, B, "r"), (7, E, "s"), (9, E, "t")]
    want = rows[:4]
    if repeats:
        # 3 repeats in full; 4 and 5 have two texts each, of which one is a near copy of another id's
        rows += [(3, C, "s"), (3, C, "s"), (4, C + " x", "t"), (4, D, "u"), (5, D, "v"), (5, A, "w"), (6, None, "x"), (6, "", "y")]
        want += [(3, C, "s"), (4, D, "u"), (5, A, "w"), (6, None, "x"), (6, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    key = lambda rows: sorted(map(repr, (tuple(r) for r in rows)))
    assert key(one_of_each(docs).collect()) == key(want)

"""One row of each component, also where an id repeats with another text or is missing."""

from tidecorpus.llm import neardup


def test_one_row_of_each_component(spark):
    words = [" ".join(f"{p}{i * 7 % 211}" for i in range(400)) for p in ("alpha", "beta", "gamma")]
    near = words[2] + " end"
    rows = [(1, words[0]), (1, words[1]), (2, words[1]), (None, words[2]), (None, near), (None, words[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["content"]: r["fingerprint"] for r in neardup.near_duplicates(df).collect()}
    assert len(found) == 4 and len(set(found.values())) == 4
    got = [(r["doc_id"], r["text"]) for r in neardup.deduplicated(df).collect()]
    assert {x for x in got if x[0]} == {(1, words[0]), (1, words[1])}
    assert len([x for x in got if x[0] is None]) == 1

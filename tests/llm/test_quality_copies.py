import random

from callweave.llm import quality_rules

DOCS = "doc_id long, text string, lang string"


def test_copies_are_one_trial(spark):
    r = random.Random(1)
    text = " ".join(f"w{r.randrange(500)}" for _ in range(80))
    labels = spark.createDataFrame([(1, 1)] + [(k, 1) for k in range(2, 3000)], "doc_id long, quality int")
    rows = [(1, text, "en")] * 3000 + [(k, text, "en") for k in range(2, 3000)]
    measured = quality_rules.measured(spark.createDataFrame(rows, DOCS))
    assert quality_rules.cutoffs(measured, labels) == {}, "one text certifies nothing, however often it stands there"
    many = [(k, f"{text} n{k}", "en") for k in range(1, 3000)]
    assert quality_rules.cutoffs(quality_rules.measured(spark.createDataFrame(many, DOCS)), labels)

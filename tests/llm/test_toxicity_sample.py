"""Verdicts of op6_toxicity do not turn on whether the classes fit into the sample."""

import random

from weftgraph.llm import op6_toxicity as op6


def test_a_thinned_class_keeps_its_share(spark):
    """Most toxic and few clean rows have a word, yet most rows with it are clean: it is no verdict at any size."""
    rng = random.Random(4)
    rows = []
    for i in range(4000):
        toxic = i % 10 == 0
        odd = rng.random() < (0.6 if toxic else 0.15)
        rows.append((i, "odd word" if odd else "plain word", int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    share = sum(t for _, x, t in rows if x == "odd word") / sum(x == "odd word" for _, x, _ in rows)
    texts = ["odd word", "plain word"]
    whole, thinned = (op6.fit(d, sample=n).scores(texts) for n in (op6.SAMPLE, 800))
    assert abs(whole[0] - share) < 0.05 and max(abs(whole - thinned)) < 0.1
    assert (whole < 0.5).all() and (thinned < 0.5).all()

import random

import numpy as np

from framequarry.llm.toxicity import score_toxicity

from .conftest import sentence


def test_scores_keep_the_class_ratio_when_examples_are_bounded(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, sentence(rng, "en", 20)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    scores = [r.score for r in score_toxicity(docs, labels, examples=20).collect()]
    assert 0.05 < np.mean(scores) < 0.2

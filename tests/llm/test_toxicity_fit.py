"""The calibration does not depend on how many labels of a class were sampled."""
import random

from tandem.llm import toxicity


def test_scores_keep_the_share_of_the_table(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        toxic = int(i % 10 == 0)
        words = [f"w{rng.randrange(400)}" for _ in range(40)]
        for _ in range(4 if rng.random() < (0.8 if toxic else 0.15) else 0):
            words[rng.randrange(40)] = f"bad{rng.randrange(6)}"
        rows.append((i, " ".join(words), toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    means = [toxicity.Scorer(toxicity.fit_model(frame, frame, fit_ordinary=n)).score([t.encode() for _, t, _ in rows]).mean()
             for n in (6000, 150)]
    assert all(0.07 < m < 0.14 for m in means), means

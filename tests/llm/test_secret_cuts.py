"""The cut of a group of tokens holds the rate of false discoveries, or there is none."""
import random

from tandem.llm import secrets_scan


def _cuts(spark, rows):
    frame = spark.createDataFrame(rows, "enc string, band int, mixed boolean, odds double, p double")
    return {(r["enc"], r["band"], r["mixed"]): r["cut"] for r in secrets_scan.cuts(frame).collect()}


def test_cuts_follow_the_share_of_random_tokens(spark):
    rng = random.Random(5)

    def tokens(enc, band, mixed, n_random, n_ordinary, top):
        return ([(enc, band, mixed, 0.01, rng.random()) for _ in range(n_random)]
                + [(enc, band, mixed, 0.01, rng.random() * top) for _ in range(n_ordinary)])

    got = _cuts(spark, tokens("base64", 0, True, 1000, 0, 1) + tokens("base64", 1, True, 100, 4000, 0.3)
                + tokens("base64", 2, False, 0, 2000, 1) + tokens("hex", 1, True, 2000, 500, 0.04)
                + tokens("base64", 3, True, 1000, 1500, 0.15))
    assert got[("base64", 0, True)] == 0.001  # nothing but random tokens: nearly all are kept
    assert ("base64", 1, True) not in got  # ordinary tokens above every cut: none, where 0.2 used to be granted
    assert ("base64", 2, False) not in got  # high p, but of a shape that random tokens do not have
    assert 0.01 <= got[("hex", 1, True)] <= 0.05
    assert ("base64", 3, True) not in got  # long tokens: no cut as high as 0.2


def test_long_random_tokens_are_found_among_paths(spark):
    rng = random.Random(6)
    random_ones = ["".join(rng.choices(secrets_scan.B64, k=40)) for _ in range(200)]
    paths = ["-".join(rng.choice(["usr", "local", "share", "python", "lib", "site", "kernel", "module", "quick", "vxz"])
                      for _ in range(6)) for _ in range(600)]
    frame = spark.createDataFrame([(0, " ".join(random_ones)), (1, " ".join(paths))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_random"] for r in secrets_scan.secret_report(frame).collect()}
    assert got[0] >= 180 and got[1] <= 5

"""Golden numbers published in FIXTURES.md, computed there by an independent
pure-Python script on the prefix form of the pairs fixture."""
import pytest
from sample_tables import SF001, SF01

from tandem.functions.text import letters_canonical
from tandem.operators import align, evaluate as ev
from tandem.sources import fixtures as fx

# The FIXTURES.md definition of the pairs fixture (prefix form, test-only input).
SURVEY_PAIRS = """
with p as (
  select u.conv_id*1000+u.turn as pair_id, pmod(u.conv_id+u.turn,6) as variant,
         substring(u.text,1,512) as caption,
         substring(regexp_replace(a.text,'[^ -~]','?'),1,256) as gt_raw
  from conv u join conv a on a.conv_id=u.conv_id and a.turn=u.turn+1
  where u.role='user' and a.role='assistant')
select pair_id, variant, caption,
  case when variant=5 and pmod(pair_id,2)=0 then '' else gt_raw end as gt_raw,
  case variant when 0 then gt_raw
    when 1 then '<pad>'||gt_raw||'</s><pad>'
    when 2 then substring(gt_raw,1,128)
    when 3 then translate(gt_raw,'aeo','eoa')
    when 4 then '<p<unk>ad></s>'
    else replace(gt_raw,' ','') end as pred_raw
from p"""

IDENTITY = {  # sf: (pairs, bad, kept, validity, bleu, exact, levenshtein)
    SF001: (34, 6, 22, 0.823529, 0.831737, 0.5, 31.772727),
    SF01: (233, 39, 156, 0.832618, 0.756575, 0.403846, 44.897436),
}
LETTERS = {  # sf: (validity, bleu_canonical, bleu_raw, exact, levenshtein, bits_167, bits_2048, counts)
    SF001: (0.823529, 0.831348, 0.831737, 0.590909, 30.5, 0.922027, 0.803591, 0.823623),
    SF01: (0.832618, 0.753205, 0.756575, 0.467949, 43.519231, 0.881795, 0.725597, 0.746692),
}
VEC = {  # sf: (rows, sim, std, cov, vicreg, neg_cosine)
    SF001: (250, 0.030982, 1.749397, 0.000122, 44.509589, -0.008575),
    SF01: (250, 0.030988, 1.749528, 0.000122, 44.513038, -0.008373),
}


def _pairs(spark, sf):
    spark.read.parquet(f"{sf}/conversations.parquet").createOrReplaceTempView("conv")
    return spark.sql(SURVEY_PAIRS)


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_identity_canonicaliser(spark, sf):
    r = ev.eval_report(ev.prepare_pairs(_pairs(spark, sf))).first()
    n, bad, kept, validity, bleu, exact, lev = IDENTITY[sf]
    assert (r.n_total, r.n_bad, r.n_kept) == (n, bad, kept)
    assert r.validity == validity and r.bleu_smi == bleu and r.bleu_self == bleu
    assert r.exact_match == exact and r.levenshtein_smi == lev


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_letters_canonicaliser(spark, sf):
    r = ev.eval_report(ev.prepare_pairs(_pairs(spark, sf), canonicalise=letters_canonical)).first()
    assert (r.validity, r.bleu_smi, r.bleu_self, r.exact_match, r.levenshtein_smi,
            r.maccs_sims, r.rdk_sims, r.morgan_sims) == LETTERS[sf]


def test_bleu_parts_sf01(spark):
    """FIXTURES.md lists the sf0.01 BLEU parts: clipped matches, denominators, lengths."""
    stats = ev.pair_stats(ev.prepare_pairs(_pairs(spark, SF01)))
    s = ev.sum_stats(stats).first()
    assert [s[f"c_m{n}"] for n in range(1, 5)] == [33371, 30695, 27931, 25995]
    assert [s[f"c_d{n}"] for n in range(1, 5)] == [34228, 34072, 33916, 33760]
    assert (s.c_hyp, s.c_ref) == (34228, 38768)


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_vec_pairs(spark, sf):
    rows, sim, std, cov, vic, negcos = VEC[sf]
    v = align.vicreg(fx.vec_pairs(spark, sf)).first()
    assert (v.n_rows, v.sim, v.std, v.cov, v.vicreg) == (rows, sim, std, cov, vic)
    assert align.neg_cosine(fx.vec_pairs(spark, sf)).first().neg_cosine == negcos


def test_clip_one_batch_golden(spark):
    from pyspark.sql import functions as F
    df = fx.vec_pairs(spark, SF001).withColumn("batch_id", F.lit(0))
    assert align.clip_loss(df).first().clip_loss == 5.520432

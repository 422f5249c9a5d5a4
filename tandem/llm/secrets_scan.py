"""Secret scans by a randomness test battery (operator 3), in SQL functions only.

Base spans (fixed by the contract of the query): assignments to secret names, access keys, long hex.
The method adds ``random`` spans: tokens of 20 or more key characters that behave like random draws.

* The encoding is inferred from the characters: hex, base32 or base64 (either variant).
* Three tests against uniform draws from that alphabet: chi-squared of the symbol counts, runs above
  and below the alphabet's middle, lag-1 serial correlation; Fisher's method combines their p-values.
* Tokens of an encoding, length band and shape share one cut. A token is *mixed* if it holds every class of its
  alphabet (letters of each case, digits), which random tokens of this length nearly always do and names, paths
  and slugs often do not. The number of random tokens is estimated apart from the cut: mixed ones from the tail
  p >= 0.5, where random tokens have the measured share ``TAIL_SHARE``; the others from the mixed ones by the
  probability that random draws of that length lack a class, whatever their own p-values are.
* The cut is the least p of the grid from which on the tokens estimated not to be random are no more than
  ``max_fdr`` of all, give or take the standard error of the tail count; a group in which no cut holds that
  has none, so its tokens are not reported. The grid ends at 0.2 for tokens under 32 characters, at 0.1 under
  48 and at 0.05 above. Not told apart: mixed ordinary tokens with p >= 0.5. The counts are over the distinct
  tokens of the whole corpus, as copies of a token are one draw.

The table of cuts has one row per encoding, band and shape (24 at most) and is read by the driver.

Defined cases: a null text is empty and has no spans; every row gives one row, null and repeated ids
included; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick
from .native_spans import blocks, count_of, fresh, joined, let, masked, moved, overlaps, spans

ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""")
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
HEX = "0123456789abcdef"
B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
GRID = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2)
GRID_END = (0.2, 0.1, 0.05, 0.05)  # of each band
TAIL, TAIL_SHARE = 0.5, 0.545  # share of random tokens with p >= TAIL: 0.52-0.56 over encodings and lengths 20-128
CLASSES = {"hex": ("[0-9]", "[a-fA-F]"), "base32": ("[2-7]", "[A-Z]"), "base64": ("[A-Z]", "[a-z]", "[0-9]")}
MAX_FDR = 0.1
#: No match holds such a character: it is of no pattern's, or a space between letters or digits.
BOUNDARY = r"""[^A-Za-z0-9"'\x20:=+/_.-]|(?<=[A-Za-z0-9])\x20(?=[A-Za-z0-9])"""


def base_spans(text: Column) -> Column:
    return F.concat(
        spans(text, "assign", 0, ASSIGN, lambda h: F.length(F.regexp_extract(h, ASSIGN_VALUE, 1)) >= 6),
        spans(text, "access", 1, r"AKIA[A-Z0-9]{16,}+"),
        spans(text, "hex", 2, r"[0-9a-f]{24,}+"))


def candidate_spans(text: Column) -> Column:
    return spans(text, "random", 3, TOKEN)


def _upper_tail(z: Column) -> Column:
    """Normal upper tail by the logistic form (absolute error below 2e-4)."""
    return let(z, lambda z: 1 / (1 + F.exp(F.least(F.greatest(
        1.5976 * z + 0.070565 * z * z * z, F.lit(-700.0)), F.lit(700.0)))))


def _clip(p: Column) -> Column:
    return F.greatest(p, F.lit(1e-12))


def encoding_of(token: Column) -> Column:
    body = F.rtrim(token, F.lit("="))
    return (F.when(F.rlike(body, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), "hex")
            .when(F.rlike(body, F.lit("^[A-Z2-7]+$")), "base32").otherwise("base64"))


def p_value(token: Column, encoding: Column) -> Column:
    """p-value of a token under uniform draws from the alphabet of its encoding."""
    body = F.rtrim(token, F.lit("="))
    plain = F.translate(body, "-_", "+/")
    return (F.when(encoding == "hex", battery(F.lower(body), HEX))
            .when(encoding == "base32", battery(body, B32)).otherwise(battery(plain, B64)))


def battery(body: Column, alphabet: str) -> Column:
    """Chi-squared, runs and serial-correlation tests combined by Fisher's method."""
    return let(body, lambda t: let(
        -(F.log(_clip(p_uniform(t, alphabet))) + F.log(_clip(p_runs(t, alphabet))) + F.log(_clip(p_serial(t, alphabet)))),
        lambda half: F.exp(-half) * (1 + half + half * half / 2)))  # half of Fisher's statistic, 6 degrees of freedom


def p_uniform(body: Column, alphabet: str) -> Column:
    """Chi-squared test of equal symbol counts (Wilson-Hilferty approximation)."""
    k = len(alphabet)
    df = float(k - 1)
    squares = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda a, i: a + F.pow(
        (F.length(body) - F.length(F.replace(body, F.lit(alphabet).substr(i, F.lit(1)), F.lit("")))).cast("double"),
        F.lit(2.0)))
    chi2 = k / F.length(body) * squares - F.length(body)
    return _upper_tail((F.cbrt(F.greatest(chi2, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)


def p_runs(body: Column, alphabet: str) -> Column:
    """Runs above and below the middle of the alphabet (two-sided)."""
    k = len(alphabet)

    def from_counts(c):
        n, both, changes = c["n"], c["both"], c["changes"]
        return let(both * (both - n) / (n * n * (n - 1)), lambda var: F.when(var > 0, F.least(
            2 * _upper_tail(F.abs(changes - both / n) / F.sqrt(var)), F.lit(1.0))).otherwise(
            F.pow(F.lit(2.0), 1 - n)))  # all symbols on one side

    def counts(half):
        n = F.length(half).cast("double")
        high = F.length(F.replace(half, F.lit("l"), F.lit(""))).cast("double")
        changes = (2 * n - F.length(F.replace(half, F.lit("hl"), F.lit(""))) - F.length(
            F.replace(half, F.lit("lh"), F.lit("")))) / 2
        return let(F.struct(n.alias("n"), (2 * high * (n - high)).alias("both"), changes.alias("changes")), from_counts)

    return let(F.translate(body, alphabet, "l" * (k // 2) + "h" * (k - k // 2)), counts)


def p_serial(body: Column, alphabet: str) -> Column:
    """Lag-1 correlation of the symbols' places in the alphabet (two-sided), in one pass over them."""
    at = F.transform(F.filter(F.split(body, ""), lambda c: F.length(c) > 0),
                     lambda c: F.position(c, F.lit(alphabet)).cast("double"))
    zero = F.lit(0.0)
    start = F.struct(*[zero.alias(f) for f in ("n", "first", "last", "sum", "square", "next")])

    def add(a, x):
        return F.struct((a["n"] + 1).alias("n"), F.when(a["n"] == 0, x).otherwise(a["first"]).alias("first"),
                        x.alias("last"), (a["sum"] + x).alias("sum"), (a["square"] + x * x).alias("square"),
                        (a["next"] + a["last"] * x).alias("next"))

    def test(a):
        n, mean = a["n"], a["sum"] / a["n"]
        square = a["square"] - n * mean * mean
        cross = a["next"] - mean * (2 * a["sum"] - a["first"] - a["last"]) + (n - 1) * mean * mean
        r = F.when(square > 1e-9, cross / square).otherwise(F.lit(1.0))
        return F.least(2 * _upper_tail(F.abs(r + 1 / n) * F.sqrt(n)), F.lit(1.0))

    return let(F.aggregate(at, start, add), test)


def band_of(token: Column) -> Column:
    n = F.length(F.rtrim(token, F.lit("=")))
    return F.when(n < 32, 0).when(n < 48, 1).when(n < 80, 2).otherwise(3)


def mixed_of(token: Column, encoding: Column) -> Column:
    """Whether the token holds every class of its encoding's characters."""
    def has(enc):
        return reduce(and_, [F.rlike(token, F.lit(c)) for c in CLASSES[enc]])

    return F.when(encoding == "hex", has("hex")).when(encoding == "base32", has("base32")).otherwise(has("base64"))


def lacks_share(encoding: Column, n: Column) -> Column:
    """Probability that ``n`` random characters lack a class of their encoding."""
    def power(a, k):
        return F.pow(F.lit(a / k), n)

    return (F.when(encoding == "hex", power(6, 16) + power(10, 16))
            .when(encoding == "base32", power(26, 32) + power(6, 32))
            .otherwise(2 * power(38, 64) + power(54, 64) - power(12, 64) - 2 * power(28, 64) + power(2, 64)))


def _tested(found: Column) -> Column:
    """Candidates with their encoding, band, shape, odds of lacking a class if random, and p-value."""
    def add(s, enc):
        lacks = lacks_share(enc, F.length(F.rtrim(s["hit"], F.lit("="))))
        return (s.withField("enc", enc).withField("band", band_of(s["hit"])).withField("mixed", mixed_of(s["hit"], enc))
                .withField("odds", lacks / (1 - lacks)).withField("p", p_value(s["hit"], enc)))

    return F.transform(found, lambda s: let(encoding_of(s["hit"]), lambda enc: add(s, enc)))


def cuts(tested: DataFrame, max_fdr: float = MAX_FDR) -> DataFrame:
    """(enc, band, mixed, cut) from (enc, band, mixed, odds, p) of all tokens; no row where no cut holds the rate."""
    tail = (F.col("mixed") & (F.col("p") >= TAIL)).cast("double")
    both = tested.groupBy("enc", "band").agg(
        *[F.sum(((F.col("p") >= c) & (F.col("mixed") == m)).cast("double")).alias(f"a{int(m)}_{i}")
          for m in (False, True) for i, c in enumerate(GRID)],
        F.sum(tail).alias("t1"), F.sum(tail * F.col("odds")).alias("t0"))
    sums = both.select("enc", "band", F.explode(F.array(*[F.struct(
        F.lit(m).alias("mixed"), (F.col(f"t{int(m)}") / TAIL_SHARE).alias("random"),
        *[F.col(f"a{int(m)}_{i}").alias(f"a{i}") for i in range(len(GRID))]) for m in (False, True)])).alias("g"))
    sums = sums.select("enc", "band", "g.*")
    end = F.get(F.array(*[F.lit(e) for e in GRID_END]), F.col("band"))

    def held(i, c):
        n, share = F.col(f"a{i}"), TAIL_SHARE / (1 - c)
        error = F.when(F.col("mixed"), F.sqrt((1 - share) / share / n)).otherwise(0.0)
        return (n > 0) & (F.lit(c) <= end) & (1 - (1 - c) * F.col("random") / n <= max_fdr + error) & (F.col("random") > 0)

    cut = F.coalesce(*[F.when(held(i, c), F.lit(c)) for i, c in enumerate(GRID)])
    return sums.select("enc", "band", "mixed", cut.alias("cut")).where("cut is not null")


def scanned(text: Column, passes=None) -> Column:
    """The blocks of a text: struct<at, block, found>, the base spans and the random ones (of all candidates those
    outside base spans for which ``passes`` holds), placed in the block."""
    def one(b):
        def added(base):
            free = F.filter(candidate_spans(b["block"]), lambda s: ~overlaps(s, base))
            good = F.filter(_tested(free), passes)
            plain = F.transform(good, lambda s: s.dropFields("enc", "band", "mixed", "odds", "p"))
            return F.struct(b["at"].alias("at"), b["block"].alias("block"), F.concat(base, plain).alias("found"))
        return let(base_spans(b["block"]), added)

    return F.transform(blocks(text, BOUNDARY), one)


def _scan(df: DataFrame, text_col: str, max_fdr: float, out: str) -> DataFrame:
    """``df`` with its scanned blocks."""
    plain = F.coalesce(F.col("text"), F.lit(""))
    token = pick(df, text=text_col).select(F.explode(blocks(plain, BOUNDARY)).alias("b")).where(
        F.rlike("b.block", F.lit(TOKEN))).select(F.explode(_tested(candidate_spans(F.col("b.block")))).alias("t")).select(
        "t.enc", "t.band", "t.mixed", "t.odds", "t.p", F.xxhash64("t.hit").alias("h")).distinct()  # copies are one draw
    limits = {(r["enc"], r["band"], r["mixed"]): r["cut"] for r in cuts(token, max_fdr).collect()}  # 24 rows at most

    def passes(s: Column) -> Column:
        ok = F.lit(False)
        for (enc, band, mixed), cut in sorted(limits.items()):
            ok = F.when((s["enc"] == enc) & (s["band"] == band) & (s["mixed"] == mixed), s["p"] >= cut).otherwise(ok)
        return ok

    return df.withColumn(out, scanned(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), passes))


def with_secrets(df: DataFrame, text_col: str = "text", max_fdr: float = MAX_FDR, out: str = "secret_spans") -> DataFrame:
    """``df`` with a column of spans: the base kinds and ``random``."""
    work = fresh(df, "scanned")
    placed = F.flatten(F.transform(F.col(work), lambda b: moved(b["found"], b["at"])))
    return _scan(df, text_col, max_fdr, work).withColumn(out, placed).drop(work)


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fdr: float = MAX_FDR) -> DataFrame:
    """One row per row of ``df``: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    rows = with_secrets(pick(df, doc_id=id_col, text=text_col), "text", max_fdr, "found").drop("text")
    found = F.col("found")
    base = F.filter(found, lambda s: s["rank"] < 3)
    return rows.select("doc_id", *[count_of(found, k).alias(f"n_{k}") for k in KINDS],
                       F.sha2(joined(base, "start", "rank").cast("binary"), 256).alias("base_sha256"),
                       joined(found, "start", "rank").alias("spans"))


def mask_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", max_fdr: float = MAX_FDR) -> DataFrame:
    """``df`` with every secret span replaced by ``mark``; texts without one, null too, stay as they are."""
    work = fresh(df, "scanned")
    rows = _scan(df, text_col, max_fdr, work)
    hit = F.exists(F.col(work), lambda b: F.size(b["found"]) > 0)
    clean = F.array_join(F.transform(F.col(work), lambda b: masked(b["block"], b["found"], mark)), "")
    return rows.withColumn(text_col, F.when(hit, clean).otherwise(F.col(f"`{text_col}`"))).drop(work)

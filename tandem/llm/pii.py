"""Personal data by weak supervision (operator 9), in SQL functions only.

Base spans (fixed by the contract of the query): e-mail addresses, IPv4 addresses, card numbers that
pass Luhn, international phone numbers. The method adds ``weak`` spans:

1. *candidates*: loose number groups (7 or more digits) and ``name@host`` strings;
2. *labelers* vote on each (personal, not personal, abstain): strict formats, digit counts, a gazetteer of
   context words before the span in four languages, words that announce other numbers, shapes of
   dates and decimals, money and unit signs after it, letters glued to it;
3. votes are counted by pattern over the corpus (3**6 patterns at most), and expectation-maximisation
   over these counts, one row and one ``aggregate`` in SQL, estimates how reliable each labeler is
   and how likely each pattern is personal;
4. these likelihoods are the soft labels of the final classifier of spans, naive Bayes over features that the
   labelers do not vote on (number of digits, separators, the characters beside it, the word before it by hash): a
   table of about a hundred log odds. A candidate that does not overlap a base span and has odds above 1 is a ``weak`` span.

The tables read by the driver are bounded by the patterns and the features, not by the data.

Defined cases: a null text is empty and has no spans; every row gives one row, null and repeated ids
included; an empty table gives no rows; without candidates there are no ``weak`` spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick
from .native_spans import (BLOCK_CHARS, LEFT_CHARS, RIGHT_CHARS, blocks, count_of, fresh, joined, let, moved, no_spans, overlaps,
                           spans)

KINDS = ("email", "ip", "card", "phone", "weak")
#: Private-use characters that stand for a dot between label characters and for a separator between digits.
DOT, SEP = "\ue000", "\ue001"
EMAIL = rf"(?:(?<![A-Za-z0-9._%+{DOT}-])|\G)[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_PARTS = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
CARD = rf"[0-9][0-9{SEP}]++"
CARD_LIKELY = r"[0-9](?:[\x20-]?[0-9]){12}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBERS = r"[0-9][0-9\x20().-]{5,}[0-9]"
HANDLES = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
#: No match holds such a character: it is of no pattern's, or a space before a letter or a plus sign.
BOUNDARY = r"[^A-Za-z0-9._%+@\x20()-]|\x20(?=[A-Za-z+])"
WORD_BUCKETS = 64
#: Words that announce personal numbers, in four languages (a gazetteer).
ANNOUNCE = (r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|whatsapp|mail|e-?mail|ssn|passport|account|iban|card|"
            r"telefon|handy|kontonummer|ausweis|rufnummer|portable|appelez|compte|passeport|carte|courriel|tel[eé]fono|"
            r"m[oó]vil|cuenta|pasaporte|tarjeta|correo|llame)\b[^A-Za-z0-9]{0,6}(?:[a-z]{1,8}[^A-Za-z0-9]{1,3})?$")
OTHER = (r"(?i)(?:\b(?:isbn|issn|doi|version|page|pages|vol|chapter|fig|figure|table|no|nr|id|order|rfc|seite|kapitel|"
         r"p[aá]gina|tome|build|release)\b[^A-Za-z0-9]{0,4}|https?://\S*|www\.\S*|[$€£#])$")
STRICT = (r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|"
          r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+)$")
DATE = r"^(?:[0-9]{4}[.-][0-9]{1,2}[.-][0-9]{1,2}|[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{2,4}|[0-9]+\.[0-9]+|(?:19|20)[0-9]{2}\s?-\s?(?:19|20)[0-9]{2})$"
UNIT = r"(?i)^\s?(?:%|€|\$|£|km|kg|mb|gb|usd|eur|px|ms)"
N_VOTES, ROUNDS = 6, 30


def _luhn(hit: Column) -> Column:
    digits = F.reverse(F.regexp_replace(hit, "[^0-9]", ""))
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(
        i % 2 == 1, digits.substr(i, F.lit(1)).cast("int")).otherwise(
        F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), digits.substr(i, F.lit(1)).cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", ""))


def base_spans(text: Column) -> Column:
    dotted = F.regexp_replace(F.translate(text, DOT, "\u0001"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    spaced = F.regexp_replace(F.translate(text, SEP, "\u0001"), r"(?<=[0-9])[\x20-](?=[0-9])", SEP)
    email = F.when(F.contains(text, F.lit("@")), spans(
        dotted, "email", 0, EMAIL, shown=lambda h: F.translate(h, DOT, "."))).otherwise(no_spans())
    card = F.when(F.rlike(text, F.lit(CARD_LIKELY)), spans(
        spaced, "card", 2, CARD, lambda h: _digits(h).between(13, 19) & _luhn(h), lambda h: F.translate(h, SEP, " "))).otherwise(no_spans())
    return F.concat(email, spans(text, "ip", 1, IP, lambda h: F.rlike(h, F.lit(IP_PARTS))), card,
                    spans(text, "phone", 3, PHONE, lambda h: _digits(h).between(9, 15)))


def candidate_spans(text: Column) -> Column:
    numbers = spans(text, "weak", 4, NUMBERS, lambda h: _digits(h) >= 7)
    handles = F.when(F.contains(text, F.lit("@")), spans(text, "weak", 4, HANDLES)).otherwise(no_spans())
    return F.concat(numbers, handles)


def _around(b: Column, s: Column) -> tuple[Column, Column]:
    """The characters before and after a span of the block ``b``."""
    lo = F.greatest(s["start"] - LEFT_CHARS, F.lit(0))
    before = F.right(F.concat(b["left"], b["block"].substr(lo + 1, s["start"] - lo)), F.lit(LEFT_CHARS))
    return before, F.left(F.concat(b["block"].substr(s["end"] + 1, F.lit(RIGHT_CHARS)), b["right"]), F.lit(RIGHT_CHARS))


def _votes(before: Column, hit: Column, after: Column, strict: Column) -> list[Column]:
    """One of 0 (not personal), 1 (abstains), 2 (personal) for each labeler."""
    def vote(yes=None, no=None):
        out = F.lit(1)
        if no is not None:
            out = F.when(no, 0).otherwise(out)
        return out if yes is None else F.when(yes, 2).otherwise(out)

    n, handle = _digits(hit), F.contains(hit, F.lit("@"))
    return [vote(yes=strict | F.rlike(hit, F.lit(STRICT))), vote(yes=handle | n.between(9, 16), no=(n > 19) & ~handle),
            vote(yes=F.rlike(before, F.lit(ANNOUNCE))), vote(no=F.rlike(before, F.lit(OTHER))),
            vote(no=F.rlike(hit, F.lit(DATE))),
            vote(no=F.rlike(after, F.lit(UNIT)) | F.rlike(F.right(before, F.lit(1)), F.lit(r"[\p{L}_]")))]


def _features(before: Column, hit: Column, after: Column) -> list[Column]:
    n = _digits(hit)
    kind = F.when(F.contains(hit, F.lit("@")), "handle").when(F.rlike(hit, F.lit(r"^[0-9]+$")), "plain").when(
        F.contains(hit, F.lit("(")), "bracket").when(F.contains(hit, F.lit("-")), "dash").when(
        F.contains(hit, F.lit(".")), "dot").otherwise("space")
    edge = lambda c: F.when(F.length(c) == 0, "none").when(F.rlike(c, F.lit(r"^[\p{L}_]")), "letter").when(
        F.rlike(c, F.lit(r"^\s")), "space").otherwise("sign")
    word = F.regexp_extract(F.lower(before), r"(\p{L}+)[^\p{L}]*$", 1)
    return [F.concat(F.lit("digits:"), F.least(n, F.lit(20)).cast("string")), F.concat(F.lit("kind:"), kind),
            F.concat(F.lit("left:"), edge(F.right(before, F.lit(1)))), F.concat(F.lit("right:"), edge(F.left(after, F.lit(1)))),
            F.concat(F.lit("word:"), F.when(word == "", "none").otherwise(F.pmod(F.xxhash64(word), F.lit(WORD_BUCKETS)).cast("string")))]


def _judged(b: Column, found: Column, base: Column) -> Column:
    """Each candidate of a block with its vote places (3 * labeler + vote) and its features."""
    def one(s):
        before, after = _around(b, s)

        def judge(strict):
            votes = _votes(before, s["hit"], after, strict)
            return F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"),
                            s["hit"].alias("hit"), F.array(*[v + 3 * j for j, v in enumerate(votes)]).alias("votes"),
                            F.array(*_features(before, s["hit"], after)).alias("features"), strict.alias("in_base"))
        return let(overlaps(s, base), judge)

    return F.transform(found, one)


def scanned(text: Column) -> Column:
    """The blocks of a text: struct<base, weak>, the base spans and the judged candidates, placed in the text."""
    def one(b):
        return let(base_spans(b["block"]), lambda base: F.struct(
            moved(base, b["at"]).alias("base"), moved(_judged(b, candidate_spans(b["block"]), base), b["at"]).alias("weak")))

    return F.transform(blocks(text, BOUNDARY), one)


def label_model(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(votes, q) from (votes, n): expectation-maximisation of a two-class model with independent
    labelers over the counted patterns; q is the likelihood that a candidate is personal."""
    m = 3 * N_VOTES
    start_yes = [x for _ in range(N_VOTES) for x in (0.1, 0.5, 0.4)]
    start_no = [x for _ in range(N_VOTES) for x in (0.4, 0.5, 0.1)]
    one = patterns.agg(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("rows"))

    def chance(state, votes):
        odds = F.aggregate(votes, F.log(state["pi"] / (1 - state["pi"])), lambda a, v: a + F.log(
            F.get(state["yes"], v)) - F.log(F.get(state["no"], v)))
        return 1 / (1 + F.exp(F.least(F.greatest(-odds, F.lit(-500.0)), F.lit(500.0))))

    def step(state, _):
        soft = F.transform(F.col("rows"), lambda r: F.struct(
            r["votes"].alias("votes"), (r["n"] * chance(state, r["votes"])).alias("y"), r["n"].alias("n")))
        yes = F.aggregate(soft, F.lit(0.0), lambda a, r: a + r["y"])
        total = F.aggregate(soft, F.lit(0.0), lambda a, r: a + r["n"])

        def share(v, weight, whole):
            return (F.aggregate(soft, F.lit(0.5), lambda a, r: F.when(F.array_contains(r["votes"], v), a + weight(r)).otherwise(a))
                    / (whole + 1.5))

        places = F.sequence(F.lit(0), F.lit(m - 1))
        return F.struct(((yes + 1) / (total + 2)).alias("pi"),
                        F.transform(places, lambda v: share(v, lambda r: r["y"], yes)).alias("yes"),
                        F.transform(places, lambda v: share(v, lambda r: r["n"] - r["y"], total - yes)).alias("no"))

    begin = F.struct(F.lit(0.5).alias("pi"), F.array(*map(F.lit, start_yes)).alias("yes"),
                     F.array(*map(F.lit, start_no)).alias("no"))
    fitted = one.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step))
    return fitted.select("state", F.explode("rows").alias("r")).select(
        "r.votes", chance(F.col("state"), F.col("r.votes")).alias("q"))


def classifier(candidates: DataFrame) -> tuple[float, dict[str, float]]:
    """(prior log odds, log odds by feature) from (votes, features) of all candidates."""
    counted = candidates.groupBy("votes", "features").agg(F.count("*").alias("n"))
    patterns = counted.groupBy("votes").agg(F.sum("n").alias("n"))
    soft = counted.join(label_model(patterns), "votes").withColumn("y", F.col("n") * F.col("q"))
    each = soft.select(F.explode(F.concat(F.array(F.lit("")), "features")).alias("f"), "n", "y")
    table = each.groupBy("f").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    rows = {r["f"]: (r["y"], r["n"] - r["y"]) for r in table.collect()}  # a few dozen features
    if "" not in rows:
        return 0.0, {}
    import math

    yes, no = rows.pop("")
    prior = math.log((yes + 1) / (no + 1))
    return prior, {f: math.log((a + 0.5) / (yes + 1)) - math.log((b + 0.5) / (no + 1)) for f, (a, b) in rows.items()}


def with_personal_data(df: DataFrame, text_col: str = "text", out: str = "personal_spans") -> DataFrame:
    """``df`` with a column of spans: the base kinds and ``weak``."""
    plain = F.coalesce(F.col("text"), F.lit(""))
    likely = F.length(plain) > BLOCK_CHARS
    for hint in (NUMBERS, HANDLES):
        likely = likely | F.rlike(plain, F.lit(hint))
    seen = pick(df, text=text_col).where(likely).select(F.explode(scanned(plain)).alias("b")).select(
        F.explode("b.weak").alias("c")).select("c.votes", "c.features")
    prior, table = classifier(seen)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    work = fresh(df, "scanned")
    rows = df.withColumn(work, scanned(text))
    base = F.flatten(F.transform(F.col(work), lambda b: b["base"]))
    if not table:
        return rows.withColumn(out, base).drop(work)
    odds = F.create_map(*[x for f, v in sorted(table.items()) for x in (F.lit(f), F.lit(float(v)))])

    def kept(b):
        good = F.filter(b["weak"], lambda s: ~s["in_base"] & (F.aggregate(
            s["features"], F.lit(float(prior)), lambda a, f: a + F.coalesce(F.element_at(odds, f), F.lit(0.0))) > 0))
        return F.transform(good, lambda s: s.dropFields("votes", "features", "in_base"))

    weak = F.flatten(F.transform(F.col(work), kept))
    return rows.withColumn(out, F.concat(base, weak)).drop(work)


def personal_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_email, n_ip, n_card, n_phone, n_weak, base_sha256, spans."""
    rows = with_personal_data(pick(df, doc_id=id_col, text=text_col), "text", "found").drop("text")
    found = F.col("found")
    base = F.filter(found, lambda s: s["rank"] < 4)
    return rows.select("doc_id", *[count_of(found, k).alias(f"n_{k}") for k in KINDS],
                       F.sha2(joined(base, "rank", "start").cast("binary"), 256).alias("base_sha256"),
                       joined(found, "rank", "start").alias("spans"))

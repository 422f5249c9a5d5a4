"""Column expressions for text: prompt rendering, output cleaning, tokens.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen and run where the rows are (no shuffle, no Python).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values (must equal the modelled system's for identical results) ---
# Prompt wrapped around a caption when instructions are on.
PROMPT_PREFIX = "Task: Translate description to SELFIES representation.\nInput: "
PROMPT_SUFFIX = "\nOutput:"
# Special tokens removed from generated text, in this order.
SPECIAL_TOKENS_REMOVED = ("<unk>", "<pad>", "</s>")
# Special tokens of the vocabulary and their ids: pad, end of sequence, unknown.
PAD_TOKEN, EOS_TOKEN, UNK_TOKEN = "<pad>", "</s>", "<unk>"
PAD_ID, EOS_ID, UNK_ID = 0, 1, 2
# --- end of fixed values ---

# Leading/trailing white space in the Unicode sense (Python's ``str.strip``).
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_space(c) -> Column:
    """Remove leading and trailing Unicode white space (``trim`` only drops spaces)."""
    return F.regexp_replace(_col(c), _EDGE_SPACE, "")


def clean_generated(c) -> Column:
    """Delete ``<unk>``, then ``<pad>``, then ``</s>``, then strip.

    Sequential replaces, not one alternation: ``<p<unk>ad>`` must first
    become ``<pad>`` and then disappear.
    """
    out = _col(c)
    for tok in SPECIAL_TOKENS_REMOVED:
        out = F.replace(out, F.lit(tok), F.lit(""))
    return strip_space(out)


def render_prompt(caption, add_instruction: bool = True,
                  prefix: str = PROMPT_PREFIX, suffix: str = PROMPT_SUFFIX) -> Column:
    """The model input for a caption; a NULL caption renders as ''."""
    cap = F.coalesce(_col(caption), F.lit(""))
    if not add_instruction:
        return cap
    return F.concat(F.lit(prefix), cap, F.lit(suffix))


def char_tokens(c) -> Column:
    """Code-point tokens; '' gives no token (``split`` alone would give
    one empty token), NULL stays NULL."""
    c = _col(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def word_tokens(c) -> Column:
    """Words of a text, cut at single spaces; empty ones are no tokens, NULL stays NULL."""
    return F.filter(F.split(_col(c), " "), lambda w: w != "")


def letters_canonical(c) -> Column:
    """Text canonicaliser used by the fixtures: lower case, keep a-z and space,
    squeeze runs of spaces, trim. Empty result means 'no valid form'."""
    s = F.regexp_replace(F.lower(_col(c)), "[^a-z ]", "")
    s = F.regexp_replace(s, " +", " ")
    return F.trim(s)


def non_empty(c) -> Column:
    """Validity rule used by the fixtures: a form is valid when it is a non-empty string."""
    c = _col(c)
    return c.isNotNull() & (F.length(c) > 0)

"""String column helpers. All return Columns built from Spark built-ins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the original behaviour) -----------------------
# Markers that flag a comment as a delta acknowledgement; plain,
# case-sensitive substring match. The real U+2206 character is not a marker.
DELTA_SYMBOLS = ["&#8710;", "!delta"]

# Default prompt template used for preference training and generation.
DEFAULT_TEMPLATE_PREFIX = (
    "Instruction: When given a piece of text, your task is to craft a persuasive "
    "response that encourages the reader to reconsider or adjust their position. "
    "Employ strategies that include (but are not limited to) presenting "
    "well-supported arguments, appealing to both emotions and logic, and "
    "thoughtfully addressing counterarguments. Adapt your tone to the context, "
    "ensuring your response is assertive yet respectful. Your goal is to move the "
    "reader's stance, ideally toward your perspective, but complete reversal isn't "
    "always necessary — nudging their viewpoint or sparking doubt can be just "
    "as valuable.\n\nInput: "
)
DEFAULT_TEMPLATE_SUFFIX = "\n\nOutput: "

# Prefix used by the instruction-tuning format (no "Instruction: " lead-in,
# no trailing "Input: ").
DEFAULT_INSTRUCTION_PREFIX = (
    "When given a piece of text, your task is to craft a persuasive response "
    "that encourages the reader to reconsider or adjust their position. Employ "
    "strategies that include (but are not limited to) presenting well-supported "
    "arguments, appealing to both emotions and logic, and thoughtfully addressing "
    "counterarguments. Adapt your tone to the context, ensuring your response is "
    "assertive yet respectful. Your goal is to move the reader's stance, ideally "
    "toward your perspective, but complete reversal isn't always necessary — "
    "nudging their viewpoint or sparking doubt can be just as valuable."
)

# Instruction record layout. Note the single space on the line before
# "### Response:".
INSTRUCTION_LAYOUT = "### Instruction:\n{prefix}\n\n### Input:\n{prompt}\n \n### Response:\n{chosen}\n"

# Length of the type prefix on Reddit-style fullnames ("t1_", "t3_").
FULLNAME_PREFIX_LEN = 3
# -----------------------------------------------------------------------------


def strip_type_prefix(c: Column | str) -> Column:
    """Drop the 3-character type prefix (``t1_``/``t3_``) of a fullname.

    Mirrors ``SUBSTRING(x, 4)``: the prefix is not checked.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(c, FULLNAME_PREFIX_LEN + 1, 1 << 30)


def utf8_clean(c: Column | str) -> Column:
    """Bytes -> text with invalid UTF-8 sequences dropped.

    Valid input is cast untouched; for invalid input the bad sequences are
    replaced by U+FFFD and then removed. A genuine U+FFFD is kept: it is
    escaped (with U+0001, itself escaped first) while the bad ones go. String
    input passes through (its bytes are re-validated).
    """
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    esc, esc_self, esc_bad, bad = (F.lit(x) for x in ("\x01", "\x01a", "\x01b", "\ufffd"))
    kept = F.replace(F.make_valid_utf8(F.replace(F.replace(s, esc, esc_self), bad, esc_bad)), bad, F.lit(""))
    return F.when(F.is_valid_utf8(s), s).otherwise(F.replace(F.replace(kept, esc_bad, bad), esc_self, esc))


def contains_any(c: Column | str, needles: list[str]) -> Column:
    """True when the text contains any needle (plain, case-sensitive).

    NULL text gives NULL, like any SQL predicate. An empty needle list is false.
    """
    c = F.col(c) if isinstance(c, str) else c
    if not needles:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.instr(c, n) > 0 for n in needles])


def template(c: Column | str, prefix: str = DEFAULT_TEMPLATE_PREFIX,
             suffix: str = DEFAULT_TEMPLATE_SUFFIX) -> Column:
    """``prefix + text + suffix``; NULL text stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(prefix), c, F.lit(suffix))


def instruction_text(prompt: Column | str, chosen: Column | str,
                     prefix: str = DEFAULT_INSTRUCTION_PREFIX) -> Column:
    """One instruction-tuning string from prompt and chosen answer."""
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    chosen = F.col(chosen) if isinstance(chosen, str) else chosen
    slots = {"prefix": F.lit(prefix), "prompt": prompt, "chosen": chosen}
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", INSTRUCTION_LAYOUT)):
        if i % 2:
            parts.append(slots[piece])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def whitespace_tokens(c: Column | str) -> Column:
    """Default tokenizer: maximal runs of non-whitespace, whole text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(c, r"\s+"), lambda t: t != F.lit(""))


def run_key_from_dir(c: Column | str) -> Column:
    """Run key from a run directory ``.../run-20240101_120000-abc/files``:
    second-to-last path part, ``run-`` removed, ``-`` -> ``_``."""
    c = F.col(c) if isinstance(c, str) else c
    part = F.element_at(F.split(c, "/"), -2)
    return F.replace(F.replace(part, F.lit("run-"), F.lit("")), F.lit("-"), F.lit("_"))


def zero_pad2(c: Column | str) -> Column:
    """``f"{n:02}"``: at least two digits, never truncated."""
    c = F.col(c) if isinstance(c, str) else c
    return F.format_string("%02d", c.cast("long"))


def run_timestamp(ts: Column | str) -> Column:
    """``strftime("%Y%m%d_%H%M%S")`` of a timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def run_name(*parts: Column | str) -> Column:
    """``"_".join(parts)`` (NULL parts are skipped, like ``concat_ws``)."""
    return F.concat_ws("_", *[F.col(p) if isinstance(p, str) else p for p in parts])


def parse_kwargs(c: Column | str) -> Column:
    """A JSON object of generation kwargs -> ``map<string,string>``; malformed
    JSON fails the job (FAILFAST) instead of silently becoming NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.from_json(c, "map<string,string>", {"mode": "FAILFAST"})

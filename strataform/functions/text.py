"""Column functions over text: stripping, tokenising, n-grams, digests, seeded draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode has it and the four separators, and the patterns of the two word tokenizers.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PATTERNS = {
    "punct": r"(?U)[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?|[^\s\x1c-\x1fA-Za-z0-9]",
    "stable": r"[A-Za-z0-9_']+",
}
# An assistant's turn in a transcript, and the next speaker's.
ASSISTANT = r"(?U)(?:^|\n)\s*Assistant:\s*"
HUMAN = r"(?U)(?:^|\n|\s)Human:\s*"


def strip(text: Column | str) -> Column:
    """Without white space at either end, as Unicode has it."""
    return F.btrim(text, F.lit(BLANKS))


def tokens(text: Column | str, tokenizer: str) -> Column:
    """The array of a named tokenizer's tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(PATTERNS[tokenizer]), F.lit(0))


def ngrams(toks: Column | str, n: int) -> Column:
    """All runs of ``n`` tokens, joined by spaces; none if there are fewer."""
    toks = F.col(toks) if isinstance(toks, str) else toks
    if n == 1:
        return toks
    runs = F.transform(F.sequence(F.lit(0), F.size(toks) - n), lambda i: F.concat_ws(" ", *(F.get(toks, i + k) for k in range(n))))
    return F.when(F.size(toks) >= n, runs).otherwise(F.array().cast("array<string>"))


def last_assistant(transcript: Column | str) -> Column:
    """What the last assistant's turn of a transcript says, or null without one."""
    transcript = F.col(transcript) if isinstance(transcript, str) else transcript
    after = F.element_at(F.split(transcript, ASSISTANT), -1)
    return F.when(transcript.rlike(ASSISTANT), strip(F.element_at(F.split(after, HUMAN, 2), 1)))


def draw(*key: Column) -> Column:
    """A number below 2**32 that depends on the key alone: the same in every engine and on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in key)).cast("binary")), 1, 8), 16, 10).cast("long")

"""Character classes that mean the same in Spark (Java), DuckDB (RE2) and Python."""

from vakya.functions.lexicons import BLOCKS, FORWARD, MEDIA, SPAM

WS_IN = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS, NOT_WS = f"[{WS_IN}]", f"[^{WS_IN}]"
#: The same blanks for Spark alone: told by a character's type rather than by a dozen ranges, many times as fast.
BLANK, NOT_BLANK = r"(?U)[\s\x{1c}-\x{1f}]", r"(?U)[^\s\x{1c}-\x{1f}]"
W_IN = r"\p{L}\p{N}_"
LATIN_IN = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
BLOCK_IN = {k: rf"\x{{{a}}}-\x{{{b}}}" for k, (a, b) in BLOCKS.items()} | {"latin": LATIN_IN}
URL = rf"(?i)(?:https?://|www\.){NOT_WS}+"
#: The same for Spark alone.
LINK = rf"(?i)(?:https?://|www\.){NOT_BLANK.replace('(?U)', '(?U:') + ')'}+"
forward, spam, media = (x.format(ws=WS, w=W_IN) for x in (FORWARD, SPAM, MEDIA))


def quoted(x: str) -> str:
    """A SQL string."""
    return "'" + x.replace("'", "''") + "'"

#: Words of Latin letters with what isn't a letter around them, between blanks and signs that stand for D; the letters are group 1.
CORES = r"(?U)(?<![^\s\x{1c}-\x{1f}D])[^A-Za-z\s\x{1c}-\x{1f}D]*+([A-Za-z]++)[^A-Za-z\s\x{1c}-\x{1f}D]*+(?![^\s\x{1c}-\x{1f}D])"

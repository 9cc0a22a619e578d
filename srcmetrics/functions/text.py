"""Text expressions: tolerant decoding, blank lines, line counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 25 Unicode White_Space code points, written so that the
# Java, RE2 and Python regex dialects read the class alike.
WHITE_SPACE = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
BLANK = f"[{WHITE_SPACE}]"
NON_BLANK = f"[^{WHITE_SPACE}]"

# From the first visible character of a line to the end of that line.
_VISIBLE_LINE = NON_BLANK + r"[^\n]*+"
# A line break, then blanks (and blank lines) up to a visible character.
_LINE_START = rf"\n{BLANK}*+{NON_BLANK}"
# A line break that no visible line follows.
_NO_LINE_START = rf"\n(?:(?!\n){BLANK})*+(?:\n|\z)"


def decode_text(content: Column) -> Column:
    """Bytes to text; invalid UTF-8 becomes U+FFFD and never fails."""
    return F.make_valid_utf8(content.cast("string"))


def is_nonblank(line: Column) -> Column:
    """True where the line has a character that is not White_Space."""
    return F.coalesce(F.rlike(line, F.lit(NON_BLANK)), F.lit(False))


def nonblank_lines(content: Column) -> Column:
    """Number of non-blank lines of a whole text, in one regex pass."""
    return F.coalesce(F.regexp_count(content, F.lit(_VISIBLE_LINE)), F.lit(0)).cast("bigint")


def visible_line_starts(text: Column) -> Column:
    """Number of non-blank lines that begin after a line break in ``text``. Only texts with a
    blank line need their lines looked at one by one."""
    each = F.when(F.rlike(text, F.lit(_NO_LINE_START)), F.regexp_count(text, F.lit(_LINE_START))).otherwise(line_breaks(text))
    return F.when(F.contains(text, F.lit("\n")), each).otherwise(F.lit(0))


def line_breaks(text: Column) -> Column:
    """Number of ``\\n`` characters in ``text``."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def text_lines(content: Column) -> Column:
    """Array of lines: ``\\n`` ends a line, one ``\\r`` before it is dropped,
    and a final line break opens no further line."""
    parts = F.split(content, "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(
        parts
    )
    return F.transform(kept, lambda line: F.regexp_replace(line, r"\r\z", ""))

"""Text functions as columns. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character that counts as content: neither white space nor the ideographic or no-break blank.
CONTENT = r"[^\s　 ]"
PARAGRAPH_BREAK = "\n"
_MARK = "\u0001"


def nonblank(text: Column) -> Column:
    """False for null, empty and white space of any kind."""
    return F.coalesce(F.rlike(text, F.lit(CONTENT)), F.lit(False))


def paragraphs(text: Column) -> Column:
    """The non-blank lines of a text, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_BREAK), nonblank)


def sentences(text: Column) -> Column:
    """Splits after terminators (with closing quotes) followed by white space, and directly after full-width ones."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?]+[\"'”’)]*)\s+", "$1" + _MARK)
    marked = F.regexp_replace(marked, r"([。！？]+[”’」』）]*)\s*", "$1" + _MARK)
    return F.filter(F.split(marked, _MARK), nonblank)


def noise(text: Column) -> Column:
    """Takes out runs of three or more recognition marks."""
    return F.regexp_replace(text, r"[#$%&*]{3,}", "")


def apply_changes(text: Column, changes: Column) -> Column:
    """Applies literal replacements, array<struct<before, after>>, one after the other; empty ``before`` is skipped."""
    return F.aggregate(changes, text, lambda t, c: F.when(F.length(c["before"]) > 0, F.replace(t, c["before"], F.coalesce(c["after"], F.lit("")))).otherwise(t))


def only_cleaned(before: Column, after: Column, bound: Column) -> Column:
    """Whether ``after`` differs from ``before`` by at most ``bound`` edits: cleaned, not rewritten."""
    # Equal texts and lengths too far apart need no table of edits; beyond the bound levenshtein stops, with -1.
    far = F.abs(F.length(before) - F.length(after)) > bound
    return F.when(before == after, bound >= 0).when(far, False).otherwise(F.call_function("levenshtein", before, after, bound) >= 0)


def keeps_text(paragraph: Column, parts: Column) -> Column:
    """Whether the parts make up the paragraph, white space aside: nothing added, nothing left out."""
    bare = lambda x: F.regexp_replace(x, r"[\s　 ]+", "")
    return bare(paragraph) == bare(F.array_join(parts, ""))


def length_ratio(a: Column, b: Column) -> Column:
    """length(b) / length(a); null where a is empty."""
    return F.try_divide(F.length(b).cast("double"), F.length(a).cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(100.0 * part.cast("double"), whole.cast("double"))


def content_hash(*cols: Column) -> Column:
    return F.sha2(F.concat_ws(_MARK, *[F.coalesce(c.cast("string"), F.lit("\u0002")) for c in cols]), 256)


def half_width(text: Column) -> Column:
    """Full-width letters, digits and the ideographic blank to their half-width forms."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(text, wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ")


def offset(seconds: Column) -> Column:
    """Seconds into a recording as a day-time interval, to the millisecond."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(seconds, 3).cast("decimal(18,6)"))

"""Lines of text for printed pages: words wrapped to a width by the widths of their glyphs, and lines placed on pages.

Edge cases: null text has no lines, an empty one has one empty line; line feeds end lines and other white space but the blank stays in its word; a word wider than a
line is cut to full lines; characters without a width of their own take that of a digit; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths, in thousandths of the type size, of the Helvetica glyphs for the code points 32 to 126.
WIDTHS = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
OTHER = 556
BLANK = WIDTHS[0]
#: 210 mm of paper without margins of 15 mm, in thousandths of 12 points.
LINE = int((210 - 2 * 15) / 25.4 * 72 / 12 * 1000)
FIRST_TOP, TOP, STEP, BOTTOM = 20, 15, 7, 297 - 15


def glyph(character: str) -> str:
    """SQL: the width of a character."""
    return f"coalesce(get(array({','.join(map(str, WIDTHS))}), ascii({character}) - 32), {OTHER})"


def measured(text: str) -> str:
    """SQL: the width of a text; null or empty text has none."""
    return f"aggregate(filter(split(coalesce({text}, ''), ''), c -> c <> ''), 0, (a, c) -> a + {glyph('c')})"


def wrapped(paragraph: str, width: int = LINE) -> Column:
    """The lines of a paragraph (the name of a column): words go on a line while they fit behind a blank."""
    word = "struct<t:string,w:int>"
    cut = f"""aggregate(filter(split(x, ''), c -> c <> ''), named_struct('done', cast(array() as array<{word}>), 't', '', 'w', 0),
      (a, c) -> CASE WHEN a.w + {glyph('c')} > {width} AND a.t <> '' THEN named_struct('done', array_append(a.done, named_struct('t', a.t, 'w', a.w)), 't', c, 'w', {glyph('c')})
        ELSE named_struct('done', a.done, 't', concat(a.t, c), 'w', a.w + {glyph('c')}) END,
      a -> array_append(a.done, named_struct('t', a.t, 'w', a.w)))"""
    words = f"flatten(transform(split({paragraph}, ' '), x -> CASE WHEN {measured('x')} > {width} THEN {cut} ELSE array(named_struct('t', x, 'w', {measured('x')})) END))"
    return F.expr(
        f"""aggregate({words}, named_struct('done', cast(array() as array<string>), 't', cast(null as string), 'w', 0),
      (a, p) -> CASE WHEN a.t IS NULL THEN named_struct('done', a.done, 't', p.t, 'w', p.w)
        WHEN a.w + {BLANK} + p.w <= {width} THEN named_struct('done', a.done, 't', concat(a.t, ' ', p.t), 'w', a.w + {BLANK} + p.w)
        ELSE named_struct('done', array_append(a.done, a.t), 't', p.t, 'w', p.w) END,
      a -> array_append(a.done, a.t))"""
    )


def page_of(line: Column) -> Column:
    """The page, from 1, of a line, from 0: a line may start down to BOTTOM."""
    first, rest = (BOTTOM - FIRST_TOP) // STEP + 1, (BOTTOM - TOP) // STEP + 1
    return F.when(line < first, F.lit(1)).otherwise(2 + F.floor((line - first) / rest)).cast("long")


def top_of(line: Column) -> Column:
    """The distance of a line from its page's upper edge."""
    first, rest = (BOTTOM - FIRST_TOP) // STEP + 1, (BOTTOM - TOP) // STEP + 1
    return F.when(line < first, FIRST_TOP + STEP * line).otherwise(TOP + STEP * ((line - first) % rest)).cast("long")

"""Formulas in plain text: `$$...$$` over lines, `$...$` in a line where it can't be a price; code and escaped signs are left alone."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Longest formulas.
MAX_INLINE, MAX_DISPLAY = 500, 4000
_CODE = re.compile(r"(?m)^[ \t]*(?P<f>```|~~~)[^\n]*\n(?s:.*?)(?:\n[ \t]*(?P=f)[^\n]*$|\Z)|(?P<t>`+)(?!`)(?s:.*?)(?<!`)(?P=t)(?!`)")
_DISPLAY = re.compile(r"\$\$((?:\\.|[^\\$]|\$(?!\$))*)\$\$", re.S)
_INLINE = re.compile(r"\$((?:\\.|[^\\$\n])*)\$", re.S)


def formulas(text: str | None) -> list[tuple[str, str, bool, int, int]]:
    """(source, tex, display, start, end) of each formula in order."""
    text = text or ""
    code = [m.span() for m in _CODE.finditer(text)] if "`" in text or "~~~" in text else []
    free = lambda a, b: all(b <= x or a >= y for x, y in code)
    inside = lambda i: next((y for x, y in code if x <= i < y), None)
    out, i = [], 0
    while (i := next((k for k in range(i, len(text)) if text[k] in "$\\`~"), len(text))) < len(text):
        if (end := inside(i)) is not None:
            i = end
            continue
        if text[i] != "$":
            i += 2 if text[i] == "\\" else 1
            continue
        if text.startswith("$$", i):
            m = _DISPLAY.match(text, i)
            good = m and m[1].strip() and len(m[0]) <= MAX_DISPLAY and free(*m.span())
            step = 2
        else:
            m = _INLINE.match(text, i)
            before, step = text[i - 1 : i], 1
            good = (
                m and not re.fullmatch("[A-Za-z0-9]", before) and m[1][:1].strip() and m[1][-1:].strip() and not text[m.end() : m.end() + 1].isdigit()
                and re.search(r"[A-Za-z\\^_=]", m[1]) and len(m[0]) <= MAX_INLINE and free(*m.span())
            )
        if good:
            out.append((m[0], m[1].strip() if step == 2 else m[1], step == 2, *m.span()))
            i = m.end()
        else:
            i += step
    return out


_SCHEMA = "array<struct<src:string,tex:string,display:boolean,start:int,end:int>>"


def split_maths(c: Column) -> Column:
    """Formulas of a column, in Arrow batches."""

    @F.pandas_udf(_SCHEMA)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(("src", "tex", "display", "start", "end"), f)) for f in formulas(t)])

    return run(c)

"""Comments and docstrings out of Python source, line by line."""

from __future__ import annotations

import io
import re
import tokenize

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Marks that keep a comment.
KEPT = ["TODO", "FIXME", "HACK", "XXX", "NOTE", "WARN"]
_KEEP = re.compile(r"\b(?:" + "|".join(KEPT) + r")\b")


def strip(text: str) -> str:
    """The source without comments and docstrings; the count of lines stays. Source that doesn't tokenize stays as it is."""
    lines = text.splitlines(keepends=True)
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return text
    gone, fresh = [], True
    for i, t in enumerate(tokens):
        if t.type == tokenize.COMMENT and not _KEEP.search(t.string):
            gone.append((t.start, t.end))
        elif t.type == tokenize.STRING and fresh and i + 1 < len(tokens) and tokens[i + 1].type in (tokenize.NEWLINE, tokenize.ENDMARKER):
            gone.append((t.start, t.end))
        if t.type not in (tokenize.COMMENT, tokenize.NL):
            fresh = t.type in (tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING)
    for (r1, c1), (r2, c2) in reversed(gone):
        for r in range(r1, r2 + 1):
            line = lines[r - 1]
            end = "\n" if line.endswith("\n") else ""
            a, b = (c1 if r == r1 else 0), (c2 if r == r2 else len(line.rstrip("\n")))
            lines[r - 1] = line[:a] + line[b:] if line[b:] else line[:a] + end
    return "".join(lines)


@F.pandas_udf(StringType())
def stripped(text: pd.Series) -> pd.Series:
    return text.map(strip, na_action="ignore")

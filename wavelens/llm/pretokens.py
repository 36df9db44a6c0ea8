"""Splitting text into pre-tokens as the public byte-level and word vocabularies do.

Text whose characters all lie below U+0250 goes through the standard regular expressions with spelled-out classes,
which is several times faster; all other text through Unicode classes. Both give the same pieces.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow.compute as pc
import regex

# Letters, numbers and white space below U+0250, as in the Unicode character database.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \u0085\u00a0"
LONG = 1 << 18

_outside = re.compile("[^\u0000-ɏ]")


def _near(pattern: str) -> re.Pattern:
    """The pattern with its Unicode classes spelled out for characters below U+0250."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{LETTERS}{NUMBERS}]").replace(r"[\p{L}]", f"[{LETTERS}]").replace(r"[\p{N}]", f"[{NUMBERS}]")
    out = out.replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")
    return re.compile(out.replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))


def _wide(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def is_near(text: str) -> bool:
    """Whether all characters lie below U+0250."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return _outside.search(text) is None


class Splitter:
    """Calls give a text's pre-tokens in lists; a very long text comes in several, so no list holds all of it."""

    def __init__(self, pattern: str):
        self.near, self.wide = _near(pattern), _wide(pattern)

    def __call__(self, text: str):
        pattern = self.near if is_near(text) else self.wide
        if len(text) < LONG:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while some := list(islice(found, 100_000)):
            yield some


#: Fixed value: how the word vocabulary splits lower-cased text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def slices(batch, rows: int = 256, size: int = 1 << 20, column: str = "text"):
    """Parts of an Arrow batch of at most rows rows, and of about size bytes of text unless one text alone is longer; so
    few texts are Python objects at a time, and working memory follows the longest text and not the number of rows."""
    names = batch.schema.names
    if column not in names:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(names.index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = int(np.searchsorted(ends, before + size, "right")) - at
        n = max(1, min(n, rows))
        yield batch.slice(at, n)
        at += n

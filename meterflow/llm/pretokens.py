"""Pre-tokens of texts where two pattern engines agree, and units left to the library where they may not.

The tokenizers' own pattern engines and Python's `regex` may be built on different versions of
Unicode, in which a letter or digit assigned later counts as neither. A character is doubtful if
`regex` and Unicode 3.2 (the oldest version at hand) differ on whether it is a letter or a number:
any engine in between may have it either way. Everything else is split by `regex`.

A doubtful character takes with it the unit around it, from the last sure cut before it to the next
after it. A sure cut lies before white space that follows a character of any other kind: both vocabularies'
pattern takes white space into a pre-token only as its first character or in a run of white space,
and never looks back, so every engine ends a pre-token there. Such a unit is handed to the library
alone, the rest of the text keeps its pre-tokens.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

#: Unicode's White_Space, which the library's patterns mean by \s; Python's `regex` adds U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters known to be sure or doubtful, by process.
SURE: set[str] = set(map(chr, range(128)))
DOUBTFUL: set[str] = set()


def doubtful(text: str) -> set[str]:
    """The characters of the text on which engines may differ."""
    if text.isascii():
        return set()
    met = set(text)
    new = met - SURE - DOUBTFUL
    if new:
        import regex

        kind = regex.compile(r"(\p{L})|(\p{N})")
        old = unicodedata.ucd_3_2_0.category
        for c in new:
            m = kind.match(c)
            now = m.lastindex if m else None
            (SURE if now == {"L": 1, "N": 2}.get(old(c)[0]) else DOUBTFUL).add(c)
    return met & DOUBTFUL if DOUBTFUL else set()


class Splitter:
    """Pre-tokens of a pattern, given in the library's syntax."""

    def __init__(self, pattern: str):
        import regex

        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        # U+180E and what `regex` alone takes for white space are no white space to cut before, nor a sure end.
        cut = rf"(?<=[^\s{SPACE}\u180e\u200b\x1c-\x1f])(?=[ \n])"
        self.next_cut, self.last_cut = regex.compile(cut), regex.compile("(?r)" + cut)

    def ends(self, text: str, start: int = 0) -> Iterator[int]:
        """Where the pre-tokens and units from `start` on end; `start` itself ends one."""
        marks = doubtful(text)
        if marks:
            import regex

            for m in regex.finditer("[" + regex.escape("".join(sorted(marks)), literal_spaces=True) + "]", text, pos=start):
                if m.start() < start:
                    continue
                before = self.last_cut.search(text, start, m.start() + 1)
                if before is not None and before.start() > start:
                    yield from (x.end() for x in self.pattern.finditer(text, start, before.start()))
                after = self.next_cut.search(text, m.end())
                start = after.start() if after else len(text)
                yield start
        yield from (x.end() for x in self.pattern.finditer(text, start))

    def pieces(self, text: str) -> list[str]:
        if not doubtful(text):
            return self.pattern.findall(text)
        return list(self.each(text))

    def each(self, text: str) -> Iterator[str]:
        """The pieces one by one."""
        start = 0
        for end in self.ends(text):
            yield text[start:end]
            start = end

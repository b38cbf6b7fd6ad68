"""Plain-Python versions of what the operators compute."""

from __future__ import annotations

import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", score double, shard int, component_id long, held struct<a: int>, t string, th long, grp long, node long, learn boolean"

#: Null and empty texts, white space of other kinds, ties, repeated rows, a null id, non-Latin text, one long text.
ODD = [
    None, "", " \t\n\x0b\x0c\r ", "!!! ...", "one", "One two THREE", "\x1c\x00a b", "Ünïcode straße ǅ ſ K İ", "漢字 かな 한국어 العربية", "é à", "\U0001f600 emoji",
    "same text again here now", "same text again here now", "a" * 5000, "word " * 3000, "\n".join(["a line that repeats itself in full"] * 40), "don't <|endoftext|> stop #$%|<>",
]


def odd_rows() -> list[tuple]:
    rows = [(k, t, None if k % 4 == 0 else "en", None if k % 3 else "s", None) for k, t in enumerate(ODD)]
    return [*rows, rows[11], rows[11], (None, "an id is missing", "en", "s", 1), (None, None, None, None, None)]


def with_extras(rows: list[tuple]) -> list[tuple]:
    return [(*r, 0.5, 3, 7, (1,), "t", 1, 2, 3, True) for r in rows]


def space_words(text: str | None) -> list[str]:
    return SPACE_WORDS.findall((text or "").translate(UPPER))


def shingles(text: str | None, n: int) -> frozenset:
    w = space_words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components_by_force(rows: list[tuple], n: int, percent: int) -> dict:
    """Smallest id of each text's component, by text; None for texts without words."""
    sets: dict = {}
    for doc_id, text in rows:
        if (s := shingles(text, n)) and doc_id is not None:
            sets.setdefault(s, []).append(doc_id)
        elif s:
            sets.setdefault(s, [])
    keys, up = list(sets), list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, x in enumerate(keys):
        for j in range(i):
            both = len(x & keys[j])
            if 100 * both >= percent * (len(x) + len(keys[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least: dict = {}
    for k, s in enumerate(keys):
        least.setdefault(root(k), []).extend(sets[s])
    return {s: min(least[root(k)], default=None) for k, s in enumerate(keys)}

"""Containment at word boundaries between two lists of names, by automata."""

from __future__ import annotations

import unicodedata
from collections.abc import Collection, Iterator, Sequence
from functools import lru_cache

import ahocorasick


@lru_cache(maxsize=1 << 16)
def is_word(char: str) -> bool:
    """A letter, a number or an underscore, as patterns here have them."""
    return char == "_" or unicodedata.category(char)[0] in "LN"


def held(texts: Sequence[str], parts: Collection[str]) -> Iterator[tuple[str, str]]:
    """(text, part) of the parts that stand in a text with no word character
    beside them, each once: all texts are scanned once by one automaton of the parts."""
    automaton = ahocorasick.Automaton()
    for part in parts:
        automaton.add_word(part, part)
    if not len(automaton):
        return
    automaton.make_automaton()
    for text in texts:
        found = set()
        for end, part in automaton.iter(text):
            if part not in found:
                before = end - len(part)
                if (before < 0 or not is_word(text[before])) and (end + 1 == len(text) or not is_word(text[end + 1])):
                    found.add(part)
        for part in found:
            yield text, part


def contained(names: Sequence[str], refs: Sequence[str], min_chars: int, stopwords: Collection[str]) -> Iterator[tuple[str, str]]:
    """(name, ref) pairs of which the shorter, a name if they are as long, may
    stand for itself and stands in the other; each once."""

    def allowed(x: str) -> bool:
        return bool(x) and len(x) >= min_chars and x not in stopwords

    stop = set(stopwords)
    stopwords = stop
    for ref, name in held(refs, [x for x in names if allowed(x)]):
        yield name, ref
    for name, ref in held(names, [x for x in refs if allowed(x)]):
        if len(ref) < len(name):
            yield name, ref

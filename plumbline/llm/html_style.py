"""Which elements a page's own style sheets hide.

Read are the rules of ``style`` elements whose selectors are compound: a tag or
``*``, with classes and an id (``p``, ``.note``, ``div.ad#top``). What counts of a
rule are ``display`` and ``visibility``. Between rules that fit an element, the
cascade of CSS decides: importance, then inline style, ids, classes, tag, and
the later one. Selectors with combinators, attributes or pseudo-classes fit
nothing here; of ``@media`` the blocks for all media and for screens without
further conditions are read. Sheets that a page links to are not fetched.

A sheet is scanned once, and an element looks at the rules that share its
rarest part only, so the time grows with the page.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
PART = re.compile(r"[.#][\w-]+")
BRACE = re.compile(r"[{}]")
MEDIA = re.compile(r"@media\s+(?:only\s+)?(?:all|screen)\s*", re.I)
DECLARATION = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)[^!]*(!\s*important\s*)?", re.I)

#: Weight of a declaration: whether important, whether inline, ids, classes, tag, order.
Weight = tuple[bool, bool, int, int, int, int]
#: Whether it hides, and by what weight, for display and visibility.
Decided = dict[str, tuple[Weight, bool]]


def declared(text: str) -> dict[str, tuple[bool, bool]]:
    """Of display and visibility: whether the declaration that holds is important, and whether it hides."""
    out: dict[str, tuple[bool, bool]] = {}
    for one in text.split(";"):
        found = DECLARATION.fullmatch(one.strip())
        if found:
            name, value, important = found[1].lower(), found[2].lower(), bool(found[3])
            if name == "visibility" and value not in ("hidden", "collapse", "visible", "initial") or value in ("inherit", "unset", "revert"):
                continue
            if important >= out.get(name, (False, False))[0]:
                out[name] = important, value in ("none", "hidden", "collapse")
    return out


def _without_comments(css: str) -> str:
    out, at = [], 0
    while (start := css.find("/*", at)) >= 0:
        out.append(css[at:start])
        end = css.find("*/", start + 2)
        if end < 0:
            return " ".join(out)
        at = end + 2
    return " ".join([*out, css[at:]])


def is_sheet(values: dict[str, str]) -> bool:
    """Whether a style element with these attributes is CSS for screens."""
    return values.get("type", "").strip().lower() in ("", "text/css") and values.get("media", "").strip().lower() in ("", "all", "screen")


class Styles:
    """Rules of the sheets so far."""

    def __init__(self) -> None:
        self.rules: dict[str, list[tuple[str, frozenset[str], Decided]]] = defaultdict(list)  # by a part
        self.same: dict[tuple[str, frozenset[str]], Decided] = {}
        self.uses: Counter[str] = Counter()
        self.order = 0

    def sheet(self, css: str) -> None:
        if "display" not in css.lower() and "visibility" not in css.lower():
            return
        css = _without_comments(css).replace("<!--", " ").replace("-->", " ")
        at, inside = 0, 0
        while at < len(css):
            opens = css.find("{", at)
            stop = css.find(";", at, opens if opens >= 0 else len(css))
            shut = css.find("}", at, opens if opens >= 0 else len(css))
            if inside and shut >= 0 and (stop < 0 or shut < stop):
                at, inside = shut + 1, inside - 1
                continue
            if stop >= 0 and css[at:stop].lstrip().startswith("@"):
                at = stop + 1
                continue
            if opens < 0:
                return
            prelude = css[at:opens].strip()
            at = opens + 1
            if prelude.startswith("@"):
                if MEDIA.fullmatch(prelude):
                    inside += 1
                    continue
                depth = 1
                for brace in BRACE.finditer(css, at):
                    depth += 1 if brace[0] == "{" else -1
                    if not depth:
                        at = brace.end()
                        break
                else:
                    return
                continue
            end = css.find("}", at)
            end = end if end >= 0 else len(css)
            self._rule(prelude, declared(css[at:end]))
            at = end + 1

    def _rule(self, selectors: str, says: dict[str, tuple[bool, bool]]) -> None:
        self.order += 1
        if not says:
            return
        for one in selectors.split(","):
            found = SELECTOR.fullmatch(one.strip())
            if not found or not found[0]:
                continue
            tag = (found[1] or "*").lower()
            parts = frozenset(PART.findall(found[2]))
            ids = sum(p[0] == "#" for p in PART.findall(found[2]))
            classes = len(PART.findall(found[2])) - ids
            held = self.same.get((tag, parts))
            if held is None:
                held = self.same[tag, parts] = {}
                self.uses.update(parts)
                key = min(parts, key=lambda p: (self.uses[p], p)) if parts else tag
                self.rules[key].append((tag, parts, held))
            for name, (important, hides) in says.items():
                weight = (important, False, ids, classes, int(tag != "*"), self.order)
                if name not in held or weight > held[name][0]:
                    held[name] = weight, hides

    def decide(self, tag: str, values: dict[str, str]) -> dict[str, bool]:
        """Of display and visibility, where anything is said: whether the element is hidden by it."""
        best: Decided = {}
        if self.same:
            own = {f".{c}" for c in values.get("class", "").split()} | ({f"#{values['id']}"} if values.get("id") else set())
            for key in ("*", tag, *own):
                for name, parts, held in self.rules.get(key, ()):
                    if name in ("*", tag) and parts <= own:
                        for what, (weight, hides) in held.items():
                            if what not in best or weight > best[what][0]:
                                best[what] = weight, hides
        style = values.get("style")
        if style:
            for what, (important, hides) in declared(style).items():
                weight = (important, True, 0, 0, 0, 0)
                if what not in best or weight > best[what][0]:
                    best[what] = weight, hides
        return {what: hides for what, (_, hides) in best.items()}

"""One form for texts that look the same.

Tokens (runs of letters, accents and invisible characters) are compared by a weighted edit
automaton that walks a trie of known spellings: look-alike letters and full-width forms match
at no cost, invisible characters are skipped at no cost, accents are matched composed or
decomposed.  A token that reaches a known spelling takes it, the most frequent of several.  A
token that no one script can write (a Latin word with a Greek letter that has no exact Latin
twin) may also use letters that look alike in many typefaces only; each costs a little, and
only a known spelling makes up for it, so those tokens are decided by the automaton alone.
Other edits cost more than any budget allows.

A token that reaches no known spelling is normalised by a table: full-width forms to plain
ones, invisible characters dropped, accents composed, look-alike letters to Latin, or to
Cyrillic or Greek where a letter of the token has no Latin twin and that script can write all
of it.  Blanks and other full-width forms are normalised by table everywhere.

The form of a token depends on its table form alone, so tokens that differ in nothing but
exact twins get one form whatever the vocabulary holds.  Case, line ends, missing accents and
letters of the same script stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

# Letters of other scripts that have the shape of a Latin letter.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХԌԚԜҮ" "аеѕіјорсухһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ονϲϳ",
        "ABESIJKMHOPCTYXGQWY" "aesijopcyxhdqw" "ABEZHIKMNOPTYX" "ovcj",
        strict=True,
    )
) | dict(zip("ΓΠΦ", "ГПФ", strict=True))
# Characters without a shape.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯﻿" + "".join(
    map(chr, range(0xFE00, 0xFE10))
)
BLANKS = "  " + "".join(map(chr, range(0x2000, 0x200B))) + "  　"
MARKS = "̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿︠-︯"
WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict(zip("￠￡￢￣￤￥￦", "¢£¬¯¦¥₩", strict=True))

# Letters of different scripts that look alike in many typefaces only.
NEAR_TWINS = ("aα", "iι", "kκк", "mм", "oσ", "pρ", "tτт", "uυ", "yγ", "фφ", "пπ")

_INVISIBLE = dict.fromkeys(map(ord, INVISIBLE))
_OTHER = {ord(c): " " for c in BLANKS} | {ord(a): b for a, b in WIDE.items() if not a.isalpha()}
OTHER = re.compile(f"[{re.escape(''.join(map(chr, _OTHER)))}]")
_WIDE = {ord(a): b for a, b in WIDE.items()}
_LETTERS = {ord(a): b for a, b in LOOK_ALIKES.items()}
_NEAR = {c: group[0] for group in NEAR_TWINS for c in group}
#: Greek and Cyrillic letters: tokens with any of them may have a known spelling.
_FOREIGN = "Ͱ-ԯ"
#: Characters whose canonical composition differs from themselves (singletons such as the kelvin sign, and excluded compositions).
_SINGLETONS = "".join(c for c in map(chr, range(0x340, 0x3000)) if unicodedata.normalize("NFC", c) != c)
SUSPECT = re.compile(f"[{re.escape(INVISIBLE)}{BLANKS}{MARKS}{re.escape(''.join(WIDE))}{_FOREIGN}{re.escape(_SINGLETONS)}ᄀ-ᇿ]")
# digits and the low line are no part of tokens in any width, so all disguises of a text have the same tokens
_IN_TOKEN = rf"(?:[^\W\d_]|[{MARKS}{re.escape(INVISIBLE)}])"
_BEFORE = rf"(?<![^\W\d_])(?<![{MARKS}{re.escape(INVISIBLE)}])"
#: A whole token that isn't ASCII.
TOKEN = re.compile(rf"{_BEFORE}[A-Za-z]*(?![\x00-\x7f]){_IN_TOKEN}+")


def suspect(text: str) -> bool:
    """Whether the form may change a text; Latin-1 texts are told without a search of every character."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return SUSPECT.search(text) is not None
    return "\xa0" in text or "\xad" in text


def table_form(token: str) -> str:
    """The form of a token by table alone."""
    text = unicodedata.normalize("NFD", token.translate(_INVISIBLE).translate(_WIDE))
    return unicodedata.normalize("NFC", text.translate(_LETTERS))


def script(c: str) -> str:
    """Script of a letter, blank for other characters and letters that belong to no one script."""
    return unicodedata.name(c, "?").split()[0] if c.isalpha() else ""


# for each script the letters it has in place of those of the table form; of several the first listed
_IN_SCRIPT: dict[str, dict[int, str]] = {"CYRILLIC": {}, "GREEK": {}}
for _a, _b in LOOK_ALIKES.items():
    _IN_SCRIPT[script(_a)].setdefault(ord(_b), _a)


@lru_cache(maxsize=100_000)
def spelling(key: str) -> tuple[str, bool]:
    """The spelling of a table form in the one script that can write it, Latin first, and whether one can."""
    text = unicodedata.normalize("NFD", key)
    letters = {c: script(c) for c in set(text)}
    own = {s for s in letters.values() if s in ("LATIN", "CYRILLIC", "GREEK")}
    if len(own) < 2 and not own & {"CYRILLIC", "GREEK"}:
        return key, True
    for name, twins in _IN_SCRIPT.items():
        if all(s not in ("LATIN", "CYRILLIC", "GREEK") or s == name or ord(c) in twins for c, s in letters.items()):
            return unicodedata.normalize("NFC", text.translate(twins)), True
    return key, False


def has_own_letters(word: str) -> bool:
    """Whether a spelling is of one script other than Latin and has a letter that no Latin one looks like."""
    text = unicodedata.normalize("NFD", word)
    scripts = {script(c) for c in text if c.isalpha()}
    return len(scripts) == 1 and scripts <= {"CYRILLIC", "GREEK"} and any(c.isalpha() and c not in LOOK_ALIKES for c in text)


class Vocabulary:
    """Known spellings in a trie, and the edit automaton over it.

    ``counts`` maps spellings to how often they occur.  Only spellings of one script other
    than Latin that can't be read as Latin are kept, and of those that look the same the most
    frequent (ties: the lowest).
    """

    SKIP, SUBSTITUTE, INSERT, NEAR = 1.0, 1.0, 1.0, 2.0**-10

    def __init__(self, counts: Iterable[tuple[str, int]] = ()) -> None:
        best: dict[str, tuple[int, str]] = {}
        for spelling, n in counts:
            spelling = unicodedata.normalize("NFC", spelling)
            if has_own_letters(spelling):
                key = table_form(spelling)
                best[key] = min(best.get(key, (1, "")), (-n, spelling))
        self.trie: dict = {}
        for n, spelling in best.values():
            node = self.trie
            for c in unicodedata.normalize("NFD", spelling):
                node = node.setdefault(c, {})
            node[""] = (n, spelling)

    @staticmethod
    def shape(c: str) -> str:
        """What characters at no cost from one another share; blank for those that are skipped at no cost."""
        c = WIDE.get(c, c)
        return "" if ord(c) in _INVISIBLE else LOOK_ALIKES.get(c, c)

    def nearest(self, token: str, budget: float = 0.0) -> str | None:
        """The known spelling of least cost within the budget; the most frequent, then lowest, of several.

        Letters that look alike in many typefaces only cost ``NEAR`` each.
        """
        text = [self.shape(c) for c in unicodedata.normalize("NFD", token.translate(_WIDE))]
        found: list[tuple[float, int, str]] = []
        seen: dict[tuple[int, int], float] = {}
        stack = [(0, self.trie, 0.0)]
        while stack:
            at, node, cost = stack.pop()
            if seen.get((at, id(node)), budget + 1) <= cost:
                continue
            seen[at, id(node)] = cost
            if at == len(text) and "" in node:
                found.append((cost, *node[""]))
            if at < len(text):
                skip = cost + (0.0 if text[at] == "" else self.SKIP)
                if skip <= budget:
                    stack.append((at + 1, node, skip))
            for c, child in node.items():
                if c == "":
                    continue
                if at < len(text):
                    own = self.shape(c)
                    step = cost + (0.0 if own == text[at] else self.NEAR if own in _NEAR and _NEAR[own] == _NEAR.get(text[at]) else self.SUBSTITUTE)
                    if step <= budget:
                        stack.append((at + 1, child, step))
                if cost + self.INSERT <= budget:
                    stack.append((at, child, cost + self.INSERT))
        return min(found)[2] if found else None


class Normalizer:
    """The canonical form of texts; tokens are remembered within a bound."""

    MOST_REMEMBERED = 200_000

    def __init__(self, vocabulary: Vocabulary | None = None) -> None:
        self.vocabulary = vocabulary
        self.remembered: dict[str, str] = {}

    def token(self, token: str) -> str:
        if (form := self.remembered.get(token)) is None:
            key = table_form(token)
            form, one_script = spelling(key)
            if self.vocabulary is not None and key and not key.isascii():
                near = 0 if one_script else sum(c in _NEAR for c in unicodedata.normalize("NFD", key))
                form = self.vocabulary.nearest(key, min(near, 512) * Vocabulary.NEAR) or form
            if len(self.remembered) >= self.MOST_REMEMBERED:
                self.remembered.clear()
            self.remembered[token] = form
        return form

    def form(self, text: str) -> str:
        """Texts without any character that the form may change are returned as they are."""
        if text.isascii() or not suspect(text):
            return text
        return unicodedata.normalize("NFC", OTHER.sub(self._other, TOKEN.sub(self._token, text)))

    def _token(self, m: re.Match) -> str:
        return self.token(m[0])

    @staticmethod
    def _other(m: re.Match) -> str:
        return _OTHER[ord(m[0])]

"""Held-out passages inside corpus documents, by one Aho-Corasick automaton.

The words of every passage are numbered, its runs of ``run`` consecutive words become
patterns over those numbers, and all patterns of all passages go into one automaton.  A
document is brought to the common form, reduced to the words of its cues and scanned once.
A document and a passage share a run of at least ``run`` words exactly if one pattern of the
passage occurs.  Where places are asked for, the cleaned text carries the offset of each of
its characters in the original, and hits that overlap or touch are one span.

An automaton holds passages of at most ``MOST_CHARS`` characters and is built once in each
Python worker; more passages are divided by a hash into several automata, each with its own
scan, which gives the same rows since a run belongs to passages one by one.  The corpus is
scanned where it lies, without a shuffle.

Defined cases: null and empty texts and texts without a time line hold nothing; passages
shorter than ``run`` words can't be found; passages that share sentences are all reported;
texts are read whole whatever their length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boskage.llm.forms import OTHER, TOKEN, Normalizer

RUN = 12
#: Characters of passages that one automaton holds on average (about 150 MB of nodes in each Python worker).
MOST_CHARS = 2_000_000

WORD = re.compile(r"[^\W_]+")
#: A time line with the cue number before it; digits may be misread.
TIME_LINE = re.compile(r"^(?:[^\S\n]*[\dlioszb|]{1,9}[^\S\n]*\n)?[^\n]*?-->[^\n]*$", re.M)
#: Markup and bracketed sound descriptions within a cue (cues are divided by \x01).
ASIDE = re.compile(r"<[^<>\n\x01]*>|\{[^{}\n\x01]*\}|(\[[^\[\]\x01]*\]|\([^()\x01]*\))")
#: A time line at the end of a file that was cut off within it.
CUT_OFF = re.compile(r"\n(?:[^\S\n]*[\dlioszb|]{1,9}[^\S\n]*\n)?[^\S\n]*[\dlo]{2}:[\dlo:,. -]*\Z")

# Letters that look like Latin ones in upper case only: after lowering, words that the common
# form spelled in either script meet in one key.  Made from the rule, not listed.
_FOLD = {
    ord(c.lower()): latin.lower()
    for c, latin in zip("АВЕЅІЈКМНОРСТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABESIJKMHOPCTYXABEZHIKMNOPTYX", strict=True)
} | {0x3BD: "v", 0x451: "ë", 0x457: "ï"}
_FOREIGN = re.compile("[Ͱ-ԯ]")


class Mapped:
    """A text with the place of each character in the original; edits keep the places."""

    def __init__(self, text: str, at: list[int] | None = None) -> None:
        self.text, self.at = text, list(range(len(text))) if at is None else at

    def sub(self, pattern: re.Pattern, new: Callable[[re.Match], str]) -> Mapped:
        text, at, last = [], [], 0
        for m in pattern.finditer(self.text):
            text.append(self.text[last : m.start()])
            at += self.at[last : m.start()]
            put = new(m)
            text.append(put)
            size = m.end() - m.start()
            at += [self.at[m.start() + min(k, size - 1)] for k in range(len(put))] if size else []
            last = m.end()
        text.append(self.text[last:])
        return Mapped("".join(text), at + self.at[last:])


LINE_END = re.compile(r"\r\n?")
_CASED = re.compile(r"[^\n]")


def words(text: str, normalizer: Normalizer) -> list[str]:
    """The words of a document's cues."""
    text = normalizer.form(text)
    if "\r" in text:
        text = LINE_END.sub("\n", text)
    text = TIME_LINE.sub("\x01", text.lower())
    first = text.find("\x01")
    if first < 0:
        return []
    text = ASIDE.sub(_aside, CUT_OFF.sub("", text[first:]))
    return WORD.findall(_folded(text))


def plain_words(text: str, normalizer: Normalizer) -> list[str]:
    """The words of a passage."""
    return WORD.findall(_folded(normalizer.form(text).lower()))


def _folded(text: str) -> str:
    return text if text.isascii() or not _FOREIGN.search(text) else text.translate(_FOLD)


def _aside(m: re.Match) -> str:
    return " " if m[1] else ""


def placed_words(text: str, normalizer: Normalizer) -> list[tuple[str, int, int]]:
    """The words of ``words`` with the start and end of each in the original text."""
    line = Mapped(text)
    whole = normalizer.form(text)
    if whole != text:
        line = _aligned(text, normalizer)
    line = line.sub(LINE_END, lambda m: "\n")
    line = Mapped(line.text.lower(), line.at) if len(line.text.lower()) == len(line.text) else line.sub(_CASED, lambda m: m[0].lower())
    line = line.sub(TIME_LINE, lambda m: "\x01")
    first = line.text.find("\x01")
    if first < 0:
        return []
    line = Mapped(line.text[first:], line.at[first:]).sub(CUT_OFF, lambda m: "").sub(ASIDE, _aside)
    return [(m[0], line.at[m.start()], line.at[m.end() - 1] + 1) for m in WORD.finditer(_folded(line.text))]


def _aligned(text: str, normalizer: Normalizer) -> Mapped:
    """The canonical form of a text with places: token by token, then accents composed across them."""
    line = Mapped(text).sub(TOKEN, lambda m: normalizer.token(m[0])).sub(OTHER, normalizer._other)
    if unicodedata.is_normalized("NFC", line.text):
        return line
    nfc = lambda x: unicodedata.normalize("NFC", x)
    out, at, piece, start = [], [], "", 0
    for k, c in enumerate([*line.text, None]):
        if c is not None and (not piece or unicodedata.combining(c) or nfc(piece + c) != nfc(piece) + nfc(c)):
            start = start if piece else k
            piece += c
            continue
        put = nfc(piece)
        out.append(put)
        at += [line.at[start + min(j, len(piece) - 1)] for j in range(len(put))]
        piece, start = c or "", k
    return Mapped("".join(out), at)


class Automaton:
    """All runs of all passages; words outside the passages share one number that no pattern holds."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, normalizer: Normalizer | None = None) -> None:
        self.normalizer, self.run = normalizer or Normalizer(), run
        self.letters: dict[str, str] = {}
        patterns: dict[str, set[int]] = {}
        for item, passage in items:
            if passage is None:
                continue
            line = "".join(self._letter(w) for w in plain_words(passage, self.normalizer))
            for k in range(len(line) - run + 1):
                patterns.setdefault(line[k : k + run], set()).add(item)
        self.machine = ahocorasick.Automaton()
        for pattern, owners in patterns.items():
            self.machine.add_word(pattern, tuple(sorted(owners)))
        self.empty = not patterns
        if patterns:
            self.machine.make_automaton()

    def _letter(self, word: str) -> str:
        """One character per distinct word, beyond the control characters and surrogates."""
        if word not in self.letters:
            n = len(self.letters) + 0x100
            self.letters[word] = chr(n + 0x800 if n >= 0xD800 else n)
        return self.letters[word]

    def _line(self, found: list[str]) -> str:
        get = self.letters.get
        return "".join([get(w, "\0") for w in found])

    def items(self, text: str) -> set[int]:
        held: set[int] = set()
        if not self.empty:
            for _, owners in self.machine.iter(self._line(words(text, self.normalizer))):
                held.update(owners)
        return held

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, words): where each passage is found, as character offsets in the original."""
        if not self.items(text):
            return []
        placed = placed_words(text, self.normalizer)
        runs: dict[int, list[list[int]]] = {}
        for last, owners in self.machine.iter(self._line([w for w, _, _ in placed])):
            for item in owners:
                own = runs.setdefault(item, [])
                if own and last - self.run + 1 <= own[-1][1] + 1:
                    own[-1][1] = last
                else:
                    own.append([last - self.run + 1, last])
        return [(i, placed[a][1], placed[b][2], b - a + 1) for i, own in sorted(runs.items()) for a, b in own]


_BUILT: dict[tuple, Automaton] = {}


def _automaton(items: list[tuple[int, str]], run: int) -> Automaton:
    """One automaton per Python worker."""
    key = (hash(tuple(items)), len(items), run)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items, run)
    return _BUILT[key]


def find_leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", run: int = RUN, places: bool = False, most_chars: int = MOST_CHARS) -> DataFrame:
    """(doc, item) of every document that holds a passage; with ``places`` also start_char, end_char and n_words of each span."""
    spark = docs.sparkSession
    held = items.select(F.col(item).alias("i"), F.col(passage).alias("p")).where("i is not null and p is not null")
    batches = max(1, -(-(held.agg(F.sum(F.length("p")).alias("c")).first()["c"] or 0) // most_chars))
    if batches > 1:
        held = held.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(batches)))
        parts = [find_leaks(docs, held.where(F.col("b") == k).select(F.col("i").alias(item), F.col("p").alias(passage)), doc, text, item, passage, run, places, 1 << 62) for k in range(batches)]
        return reduce(DataFrame.unionByName, parts)
    shared = spark.sparkContext.broadcast(sorted((r["i"], r["p"]) for r in held.collect()))
    kinds = f"`{doc}` {docs.schema[doc].dataType.simpleString()}, `{item}` {items.schema[item].dataType.simpleString()}"
    names = [doc, item, *["start_char", "end_char", "n_words"] * places]
    item_type = pa.int32() if items.schema[item].dataType.simpleString() == "int" else pa.int64()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for batch in batches:
            machine = machine or _automaton(shared.value, run)
            rows, found = [], []
            for at, value in enumerate(batch.column(1)):
                hits = machine.spans(value.as_py()) if places else sorted((i,) for i in machine.items(value.as_py()))
                rows.extend([at] * len(hits))
                found.extend(hits)
            columns = [pa.array([h[k] for h in found], item_type if k == 0 else pa.int32()) for k in range(4 if places else 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=names)

    more = ", start_char int, end_char int, n_words int" if places else ""
    return docs.select(doc, text).where(F.col(text).isNotNull()).mapInArrow(scan, kinds + more)

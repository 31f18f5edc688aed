"""Fields that pack several values: one row for each value, with its position.

A quote-aware finite-state tokenizer walks a field once.  Its states are *between*
values, in a *plain* value and in a *quoted* stretch, which may be all or part of a value;
it keeps the depth of brackets, steps over escaped and doubled quotes and over delimiters
escaped by a backslash, and emits a value whenever a delimiter stands outside quotes and
brackets.  A name from a reference list is one value whatever it
contains: at the start of a value the longest listed name that a delimiter or the end
follows is taken whole.

Defined cases: null and blank fields have no value; empty pieces don't count, repeated
values do; a field wholly in one pair of quotes or list brackets is opened first; a
quote that is never closed is an ordinary character, and so is one within a word; the
backslash of an escaped delimiter is left out; text of any length is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTES = {'"': '"', "'": "'", "«": "»", "“": "”", "„": "“", "‘": "’", "`": "`"}
BRACKETS = {"[": "]", "{": "}", "(": ")"}
DELIMITERS = ",;|/&+·•\t\n\r\v\f"
WORD_DELIMITERS = ("et", "and", "und")

_CHARS = re.escape(DELIMITERS)
_WORDS = "|".join(WORD_DELIMITERS)
_NUMBER = r"\(?\d{1,3}[.)](?!\d)"
#: A delimiter in running text: a character, a lone dash or word between blanks, or the number of the next entry.
DELIMITER = re.compile(rf"[{_CHARS}]|(?<=\s)(?:[-–—]|(?i:{_WORDS}))(?=\s)|(?<=\s){_NUMBER}(?=\s)")
#: What may follow a listed name for it to be the whole value.
BOUNDARY = re.compile(rf"\s*(?:\Z|[{_CHARS}\]}})])|\s+(?:[-–—]|(?i:{_WORDS}))\s|\s+{_NUMBER}\s")
NUMBERING = re.compile(rf"{_NUMBER}\s*")
#: Where the plain state has to look: escapes, quotes that may open after a blank or bracket, delimiters and brackets.
STOP = re.compile(rf"\\[{_CHARS}\\]|(?<=[\s(\[{{])[{re.escape(''.join(QUOTES))}]|[()\[\]{{}}]|{DELIMITER.pattern}")
#: What may follow a quote that closes within a value.
_CLOSED = re.compile(rf"\s|\Z|[{_CHARS}()\[\]{{}}]")
ESCAPED = re.compile(rf"\\([{_CHARS}])")
_BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A test for the JVM that is wider than the tokenizer: fields it rejects can't hold two values.
MAYBE_SEVERAL = rf"[,;|/&+·•\t\n\r\x0B\f()\[\]{{}}]|{_BLANK}[-–—]|(?i){_BLANK}({_WORDS}){_BLANK}|(?U)\d[.)]"


def lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Tokenizer:
    """Splits fields; ``names`` are taken whole, in any case, and given as spelled here."""

    def __init__(self, names: Iterable[str] = ()) -> None:
        self.known: dict[str, str] = {}
        self.trie: dict = {}
        for name in names:
            if name is None or not name.strip():
                continue
            key = lower(name.strip())
            self.known.setdefault(key, name.strip())
            node = self.trie
            for c in key:
                node = node.setdefault(c, {})
            node[""] = True

    def _name_end(self, low: str, at: int) -> int:
        """End of the longest listed name that starts at ``at`` and is followed by a boundary, else -1."""
        node, best, i = self.trie, -1, at
        while True:
            if "" in node and BOUNDARY.match(low, i):
                best = i
            if i >= len(low) or low[i] not in node:
                return best
            node, i = node[low[i]], i + 1

    @staticmethod
    def _quote_end(text: str, at: int) -> int:
        """Place of the quote that closes the one at ``at``, else -1."""
        close, i = QUOTES[text[at]], at + 1
        while i < len(text):
            if text[i] == "\\" and i + 1 < len(text):
                i += 2
            elif text[i] == close:
                if text[at] == close and text[i + 1 : i + 2] == close:
                    i += 2
                else:
                    return i
            else:
                i += 1
        return -1

    @staticmethod
    def _partners(text: str) -> dict[int, int]:
        """For each bracket that opens and closes, the place where it closes; one pass."""
        open_at, pairs = [], {}
        for m in re.finditer(r"[()\[\]{}]", text):
            if m[0] in BRACKETS:
                open_at.append(m.start())
            elif open_at:
                pairs[open_at.pop()] = m.start()
        return pairs

    def _open(self, text: str) -> str:
        """The field without the quotes or list brackets that enclose all of it."""
        text = text.strip()
        low, high, partners = 0, len(text), self._partners(text)
        while low < high:
            if text[low] in QUOTES:
                end = self._quote_end(text, low)
            elif text[low] in "[{":
                end = partners.get(low, -1)
            else:
                break
            if end != high - 1:
                break
            low, high = low + 1, high - 1
            while low < high and text[low].isspace():
                low += 1
            while low < high and text[high - 1].isspace():
                high -= 1
        return text[low:high]

    def _clean(self, value: str) -> str:
        """A value without surrounding blanks, quotes, brackets and numbering; a listed name as listed."""
        while True:
            value = value.strip()
            if (name := self.known.get(lower(value))) is not None:
                return name
            if len(value) > 1 and value[0] in QUOTES and self._quote_end(value, 0) == len(value) - 1:
                close = QUOTES[value[0]]
                value = re.sub(r"\\(.)", r"\1", value[1:-1]).replace(close * 2, close)
            elif len(value) > 1 and value[0] in BRACKETS and self._partners(value).get(0) == len(value) - 1:
                value = value[1:-1]
            elif m := NUMBERING.match(value):
                value = value[m.end() :]
            else:
                return ESCAPED.sub(r"\1", value)

    def split(self, field: str | None) -> list[str]:
        if field is None:
            return []
        text = self._open(field)
        low, size, i, values = lower(text), len(text), 0, []
        partners, unclosed = self._partners(text), set()
        closers = set(partners.values())

        def emit(piece: str) -> None:
            if value := self._clean(piece):
                values.append(value)

        while i < size:  # between values
            if text[i].isspace() or text[i] in DELIMITERS or text[i] in "[]{}":
                i += 1
                continue
            if m := NUMBERING.match(text, i):
                i = m.end()
                continue
            if (m := DELIMITER.match(text, i)) or (text[i] in "-–—" and text[i + 1 : i + 2].isspace()):
                i = m.end() if m else i + 1
                continue
            if (end := self._name_end(low, i)) > i:
                emit(text[i:end])
                i = end
                continue
            start = i
            if text[i] in QUOTES:  # quoted
                end = -1 if text[i] in unclosed else self._quote_end(text, i)
                if end < 0:
                    unclosed.add(text[i])
                i = end + 1 if end >= 0 else i + 1
                start = start if end >= 0 else i
            depth = 0  # plain, or what follows a closed quote
            while m := STOP.search(text, i):
                i = m.end()
                if (c := m[0])[0] == "\\":
                    continue
                if c in QUOTES:
                    end = -1 if c in unclosed else self._quote_end(text, m.start())
                    if end < 0:
                        unclosed.add(c)
                    elif _CLOSED.match(text, end + 1):
                        i = end + 1
                elif c in BRACKETS:
                    depth += m.start() in partners
                elif c in (")", "]", "}"):
                    if depth == 0 and m.start() in closers:  # of a list that opened before the value
                        emit(text[start : m.start()])
                        break
                    depth = max(0, depth - 1)
                elif depth == 0:
                    emit(text[start : m.start()])
                    break
            else:
                emit(text[start:])
                i = size
        return values


def split_values(df: DataFrame, key: str, field: str, names: Iterable[str] = (), at_least: int = 1) -> DataFrame:
    """``key``, ``pos`` (from 1, left to right) and ``value_text`` of every value of ``field``.

    Only fields with ``at_least`` values come out.  Only the two columns are read, so extra
    columns may have any name; rows with a null key are kept.  Narrow: no shuffle.
    """
    names = list(names)
    kind = df.schema[key].dataType
    src = df.select(F.col(key).alias("k"), F.col(field).cast("string").alias("v")).where(F.col("v").isNotNull())
    if at_least > 1:
        src = src.where(F.col("v").rlike(MAYBE_SEVERAL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen = Tokenizer(names), {}
        for batch in batches:
            rows, places, values = [], [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                if (found := seen.get(text)) is None:
                    if len(seen) >= 20_000:
                        seen.clear()
                    found = seen[text] = tokenizer.split(text)
                if len(found) >= at_least:
                    rows.extend([at] * len(found))
                    places.extend(range(1, len(found) + 1))
                    values.extend(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(values, pa.string())],
                names=[key, "pos", "value_text"],
            )

    out = f"`{key}` {kind.simpleString()}, pos int, value_text string"
    return src.mapInArrow(run, out)

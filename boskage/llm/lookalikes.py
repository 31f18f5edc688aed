"""Documents that look the same although their characters differ.

Every text is brought to the form of ``forms`` and reduced to two 128-bit digests, of the
form and of the text itself; only those are shuffled.  A class of equal-looking documents
matters if it holds more than one text; classes of exact copies never meet in a join.

Defined cases: null texts are in no class; texts of nothing but invisible characters look
like the empty text; repeated rows count as documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boskage.llm.forms import Normalizer, Vocabulary
from boskage.session import stable

#: Most known spellings.  Words beyond are spelled by table in the one script that can write them, as known ones
#: are, and join no fewer texts; only the near twins of those words aren't read as them.
MOST_WORDS = 50_000
FOREIGN = r"[Ͱ-ϿЀ-ԯ]"
_READY: dict[int, Normalizer] = {}


def count_spellings(docs: DataFrame, text: str, most: int = MOST_WORDS) -> list[tuple[str, int]]:
    """The most frequent Greek and Cyrillic spellings that occur twice or more, over all documents."""
    tokens = docs.where(F.col(text).rlike(FOREIGN)).select(F.explode(F.expr(f"regexp_extract_all(`{text}`, '{FOREIGN.replace(chr(92), chr(92) * 2)}+', 0)")).alias("w"))
    counted = tokens.groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    return [(r["w"], r["n"]) for r in counted.orderBy(F.desc("n"), "w").limit(most).collect()]


def _normalizer(counts: list[tuple[str, int]]) -> Normalizer:
    """One per Python worker, so what it remembers serves all tasks."""
    key = hash(tuple(counts))
    if key not in _READY:
        _READY.clear()
        _READY[key] = Normalizer(Vocabulary(counts))
    return _READY[key]


def _mapped(docs: DataFrame, doc: str, text: str, most: int, columns: str, give) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(count_spellings(docs, text, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalizer = None
        for batch in batches:
            normalizer = normalizer or _normalizer(shared.value)
            values = [give(x, normalizer.form(x)) for x in (v.as_py() for v in batch.column(1))]
            arrays = [pa.array(v) for v in zip(*values)] if values else [pa.array([], pa.string())] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[doc, *names])

    names = [c.split()[0] for c in columns.split(", ")]
    return docs.select(doc, text).where(F.col(text).isNotNull()).mapInArrow(run, f"`{doc}` {docs.schema[doc].dataType.simpleString()}, {columns}")


def canonical_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """(doc, form): every non-null text in the common form."""
    return _mapped(docs, doc, text, most, "form string", lambda old, new: (new,))


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _digests(old: str, new: str) -> tuple[bytes, bytes]:
    own = _digest(old)
    return (own if new == old else _digest(new)), own


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """(doc, form, own): digests of the form and of the text."""
    return _mapped(docs, doc, text, most, "form binary, own binary", _digests)


def look_alike_classes(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, class_id, n_texts): one row per document; the class is its lowest document, n_texts its different texts."""
    prints = stable(fingerprints(docs, doc, text))
    texts = prints.groupBy("form", "own").agg(F.min(doc).alias("low"))
    classes = texts.groupBy("form").agg(F.min("low").alias("class_id"), F.count("*").alias("n_texts"))
    return prints.join(classes, "form").select(doc, "class_id", "n_texts")


def look_alike_pairs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), the lower first: documents that look the same but aren't the same characters."""
    prints = stable(fingerprints(docs, doc, text))
    several = prints.groupBy("form").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a != b").select("form")
    own = prints.join(several, "form", "left_semi").select("form", "own", F.col(doc).alias("d"))
    # different texts are paired first, so copies of one text never meet each other
    texts = own.select("form", "own").distinct()
    pairs = texts.alias("a").join(texts.alias("b"), F.expr("a.form = b.form and a.own < b.own")).select(F.col("a.own").alias("x"), F.col("b.own").alias("y"))
    first = pairs.join(own.select(F.col("own").alias("x"), F.col("d").alias("dx")), "x")
    both = first.join(own.select(F.col("own").alias("y"), F.col("d").alias("dy")), "y")
    return both.where("dx != dy").select(F.least("dx", "dy").alias("doc_id_a"), F.greatest("dx", "dy").alias("doc_id_b"))

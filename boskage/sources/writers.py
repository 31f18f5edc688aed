"""Tables to files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from boskage.session import bounded_rows


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """New rows beside the old ones; nothing is read or rewritten."""
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    repaired(df).write.mode("overwrite").csv(path, sep=sep, header=True)


def memoised(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, written first if there is none."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        write_parquet(df, path)
    return spark.read.parquet(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown."""
    rows = bounded_rows(df, most, "the table")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def write_gml(edges: DataFrame, path: str) -> None:
    """The edges (src, dst, weight) of a graph in Graph Modelling Language: one file per partition, each a graph with its own nodes."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        yield pa.RecordBatch.from_pydict({"value": ["graph ["]})
        for batch in batches:
            lines = []
            for a, b, w in zip(*(c.to_pylist() for c in batch.columns)):
                for n in (a, b):
                    if n not in seen:
                        seen.add(n)
                        lines.append(f'  node [\n    id {n}\n    label "{n}"\n  ]')
                lines.append(f"  edge [\n    source {a}\n    target {b}\n    weight {w!r}\n  ]")
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["]"]})

    typed = edges.selectExpr("cast(src as bigint) src", "cast(dst as bigint) dst", "cast(weight as double) weight").where("src is not null and dst is not null")
    typed.mapInArrow(run, "value string").write.mode("overwrite").text(path)


def repaired(df: DataFrame) -> DataFrame:
    """Columns that text formats can't hold as text: structures and lists as JSON, bytes as hexadecimal digits."""
    from pyspark.sql import functions as F

    def plain(f):
        kind = f.dataType.simpleString()
        if kind == "binary":
            return F.hex(f.name).alias(f.name)
        return F.to_json(f.name).alias(f.name) if kind.startswith(("array", "map", "struct")) else F.col(f"`{f.name}`")

    return df.select(*map(plain, df.schema))

"""Corpus tables: scans with row numbers in file order or by keys, slices, caps and checks.

Slices, windows and caps are filters: a few counts tell which row numbers, or which files, bound them, so they are read by
as many tasks as the rows need, and nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources import storage


def located(spark: SparkSession, corpus: str, staged: str, config: str = "default", split: str = "train") -> str:
    """The path of a corpus: itself, if it is a Parquet table that exists, else where a named one was staged beforehand.

    Named corpora (hub ids) are never fetched here; their folders are staged/corpus/config/split.
    """
    plain, _, _ = storage.slice_of(corpus)
    if plain.endswith(".parquet") and storage.exists(spark, plain):
        return corpus
    path = f"{staged}/{corpus}/{config}/{split}"
    if not storage.exists(spark, path):
        raise FileNotFoundError(f"{corpus} is no Parquet table, and {path} isn't staged")
    return path


def file_rows(source: DataFrame) -> list[tuple[str, int]]:
    """The files of a Parquet table in the order of their paths, and how many rows each has; from footers, as no column is read.

    One row for each file comes to the driver, which lists them anyway.
    """
    each = source.select(source.metadataColumn("_metadata")["file_path"].alias("file")).groupBy("file").count()
    return sorted((r["file"], r["count"]) for r in each.collect())


def row_count(spark: SparkSession, path: str) -> int:
    return sum(n for _, n in file_rows(spark.read.parquet(path)))


def in_file_order(spark: SparkSession, path: str, start: int = 0, end: int | None = None, columns: list[str] | None = None, out: str = "row_idx") -> DataFrame:
    """Rows start to end (exclusive) of a Parquet table with their numbers: by the files' paths, then as they stand in a file.

    Only files that hold some of these rows are read, by all tasks that they give; a row's number is its place in the file
    and the number of rows in the files before it. Columns of the table named _file or _before are refused.
    """
    source = spark.read.parquet(path)
    if taken := {"_file", "_before", out} & set(columns or source.columns):
        raise ValueError(f"columns in the way: {sorted(taken)}")
    meta = source.metadataColumn("_metadata")
    held, before = [], 0
    for file, n in file_rows(source):
        if before + n > start and (end is None or before < end):
            held.append((file, before))
        before += n
    names = [f"`{c}`" for c in (columns if columns is not None else source.columns)]
    first, last = (held[0][0], held[-1][0]) if held else ("", "")
    part = source.filter(meta["file_path"].between(first, last)).select(*names, meta["file_path"].alias("_file"), meta["row_index"].alias(out))
    begins = spark.createDataFrame(held, "_file string, _before long")
    numbered = part.join(begins, "_file").withColumn(out, F.col(out) + F.col("_before")).select(*names, out)
    return row_range(numbered, start or None, end, out)


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, order: str | None = "row_idx") -> DataFrame:
    """A Parquet table; a ``@[a:b]`` suffix of the path keeps rows of that range of the order column, or without one (None) of the file order."""
    plain, start, end = storage.slice_of(path)
    if order is None:
        return in_file_order(spark, plain, start or 0, end, columns).drop("row_idx")
    df = spark.read.parquet(plain)
    if columns:
        require(df, columns)
        df = df.select(*columns)
    return row_range(df, start, end, order) if start is not None or end is not None else df


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def numbered(df: DataFrame, *keys: str, out: str = "row_idx") -> DataFrame:
    """df with row numbers 0, 1, ... in the order of keys that fix it.

    Rows are dealt to tasks by range and sorted there. That table is written to the shared folder once, with each row's
    range and place, since ranges are sampled anew, and merged otherwise, whenever they are computed. Then the sizes of the
    ranges before a row's own (one row for each range) are added. Columns of df named _id or _part are refused.
    """
    if taken := {"_id", "_part"} & set(df.columns):
        raise ValueError(f"columns in the way: {sorted(taken)}")
    placed = storage.kept(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    own = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + own).drop("_id", "_part", "_before")


def row_range(df: DataFrame, start: int | None, end: int | None, order: str = "row_idx") -> DataFrame:
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col(order) >= start)
    if end is not None:
        keep = keep & (F.col(order) < end)
    return df.filter(keep)


#: Rows that a step of nth_numbers() may bring to the driver.
BUCKETS = 65_536


def nth_numbers(rows: DataFrame, ranks: list[int], order: str = "row_idx") -> list[int | None]:
    """For each rank r (from 0) the number that exactly r rows are less than; None if there aren't more. Numbers are unique.

    Rows are counted by ranges of numbers, then by narrower ranges within the one that holds the rank: two counts do for four
    billion numbers. Only the order column is read.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()

    def find(a: int, b: int, rank: int) -> int | None:
        while True:
            width = -(-(b - a + 1) // BUCKETS)
            bucket = F.expr(f"(`{order}` - {a}L) div {width}L").alias("bucket")
            counts = sorted((r["bucket"], r["count"]) for r in row_range(rows, a, b + 1, order).groupBy(bucket).count().collect())
            seen = 0
            for at, n in counts:
                if rank < seen + n:
                    break
                seen += n
            else:
                return None
            if width == 1:
                return a + at
            a, b, rank = a + at * width, min(b, a + (at + 1) * width - 1), rank - seen

    return [None if low is None else find(int(low), int(high), r) for r in ranks]


def window(df: DataFrame, skip: int, n: int, columns: list[str], optional: list[str] = (), order: str = "row_idx") -> DataFrame:
    """n rows behind the first ``skip`` in order, with the columns and those of the optional ones that the table has."""
    require(df, [*columns, order])
    first, end = nth_numbers(df, [skip, skip + n], order)
    found = df.filter(F.lit(False)) if first is None else row_range(df, first, end, order)
    return found.select(*columns, *[c for c in optional if c in df.columns])


def zipped(a: DataFrame, b: DataFrame, order: str = "row_idx") -> DataFrame:
    """The columns of two tables side by side, by their row numbers (from 0, without gaps), which must be as many."""
    rows = a.count(), b.count()
    if rows[0] != rows[1]:
        raise ValueError(f"{rows[0]} rows beside {rows[1]}")
    return a.join(b, order)


def distinct_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """(distinct_texts, rows) of the table."""
    return df.agg(F.count_distinct(F.sha2(text, 256)).alias("distinct_texts"), F.count("*").alias("rows"))


def first_kept(df: DataFrame, n: int, where: Column | None = None, order: str = "row_idx") -> DataFrame:
    """The first n rows that pass, by unique whole numbers; the cap counts kept rows."""
    passing = df.filter(where) if where is not None else df
    return row_range(passing, None, nth_numbers(passing, [n], order)[0], order)


def not_empty(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{name} has no rows")
    return df


def width_of(df: DataFrame, vector: str, d: int) -> DataFrame:
    """df, if every vector is d wide; variable lists don't carry their width."""
    if not df.filter(F.size(vector) != d).isEmpty():
        raise ValueError(f"{vector} isn't {d} wide in every row")
    return df

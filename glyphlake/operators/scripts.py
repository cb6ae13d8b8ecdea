"""All rows of an alignment from one table function, and edits of whole documents."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions.edits import edit_ops
from glyphlake.operators.boundary import boundary_errors
from glyphlake.operators.confusion import DELETED, INSERTED

ROWS = "kind string, row_pos int, op string, noisy string, clean string, noisy_words array<string>, clean_words array<string>, similarity double"


class AlignmentRows:
    """Table function (noisy, clean) of three kinds of rows: char and word edits, and boundary errors with their words. A null side gives no rows."""

    def eval(self, noisy: str, clean: str):
        if noisy is None or clean is None:
            return
        for kind, a, b in (("char", noisy, clean), ("word", noisy.split(), clean.split())):
            for at, (op, x, y) in enumerate(edit_ops(a, b)):
                yield kind, at, op, x, y, None, None, None
        for at, e in enumerate(boundary_errors(noisy, clean)):
            yield "boundary", at, e["type"], " ".join(e["noisy"]), " ".join(e["clean"]), e["noisy"], e["clean"], e["similarity"]


alignment_rows_udtf = F.udtf(AlignmentRows, returnType=ROWS, useArrow=True)


def alignment_rows(pairs: DataFrame, keys: list[str], noisy: str = "noisy", clean: str = "clean") -> DataFrame:
    """The keys with each row of each pair, by a lateral join: a pair is read once for all three kinds."""
    given = pairs.select(*keys, F.col(noisy).alias("_noisy"), F.col(clean).alias("_clean"))
    return given.lateralJoin(alignment_rows_udtf(F.col("_noisy").outer(), F.col("_clean").outer())).drop("_noisy", "_clean")


def edit_rows(rows: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Those of one level, as `confusion.edits` has them."""
    return rows.filter(F.col("kind") == level).select(*keys, F.col("kind").alias("level"), F.col("row_pos").alias("op_pos"), "op", "noisy", "clean")


def boundary_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The merges and splits, as `boundary.boundary_table` has them."""
    return rows.filter("kind = 'boundary'").select(*keys, F.col("row_pos").alias("error_pos"), F.col("op").alias("type"), "noisy_words", "clean_words", "similarity")


CELLS = T.ArrayType(T.StructType([*[T.StructField(n, T.StringType()) for n in ("op", "clean", "noisy")], T.StructField("n", T.LongType())]))


@F.pandas_udf(CELLS)
def _cells(clean: pd.Series, noisy: pd.Series) -> pd.Series:
    def of(c: str, n: str) -> list[tuple[str, str, str, int]]:
        # the clean text stands first, so the kinds that lack a side change places
        kinds = {"insertion": ("deletion", lambda x, y: (x, DELETED)), "deletion": ("insertion", lambda x, y: (INSERTED, y))}
        counts: Counter = Counter()
        for op, x, y in edit_ops(c, n):
            kind, cell = kinds.get(op, (op, lambda x, y: (x, y)))
            counts[kind, *cell(x, y)] += 1
        return [(*k, v) for k, v in sorted(counts.items())]

    return pd.Series([None if c is None or n is None else of(c, n) for c, n in zip(clean, noisy, strict=True)])


def document_cells(docs: DataFrame, keys: list[str], clean: str = "clean", noisy: str = "noisy") -> DataFrame:
    """(keys, op, clean, noisy, n) of edits that turn a whole clean text into the noisy one, counted within the document before any row leaves its task.

    The script is that of the two whole texts, not of sentence pairs. Null texts give no rows; repeated keys are summed.
    """
    cells = docs.select(*keys, F.explode(_cells(clean, noisy)).alias("x")).select(*keys, "x.*")
    return cells.groupBy(*keys, "op", "clean", "noisy").agg(F.sum("n").alias("n"))


def document_totals(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of matches, substitutions, deletions and insertions per document."""
    return cells.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("op") == op, F.col("n"))), F.lit(0)).alias(op) for op in ("match", "substitution", "deletion", "insertion")])


def document_confusions(cells: DataFrame, errors_only: bool = True) -> DataFrame:
    """(clean, noisy, n) over all documents."""
    rows = cells.filter("op <> 'match'") if errors_only else cells
    return rows.groupBy("clean", "noisy").agg(F.sum("n").alias("n"))


# Three sets

SIDES = ("clean", "real", "made")


def three_sets(clean: DataFrame, real: DataFrame, made: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents that all three have, with their three texts; a report of what lacks where), from one shuffle of the three tables.

    A row of the report: which sides have a document, and how many such documents there are. A null text counts as missing; of repeated keys the
    greatest text is taken; null keys do not come.
    """
    rows = None
    for side, df in zip(SIDES, (clean, real, made), strict=True):
        own = df.filter(F.col(key).isNotNull()).select(F.col(key), *[(F.col(text) if s == side else F.lit(None).cast("string")).alias(s) for s in SIDES])
        rows = own if rows is None else rows.unionByName(own)
    met = rows.groupBy(key).agg(*[F.max(s).alias(s) for s in SIDES])
    report = met.groupBy(*[F.col(s).isNotNull().alias(f"in_{s}") for s in SIDES]).agg(F.count(F.lit(1)).alias("n"))
    return met.dropna(subset=list(SIDES)), report

"""Exact-size samples drawn in the order of a hash, without sorting a whole class.

A class may hold a third of all rows, so ranking it in one window task is out of
the question. ``hash_rank_cut`` counts rows per hash prefix, finds the one prefix
in which the target is reached, and ranks only the rows of that prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import materialise

_PREFIX = 4  # hex digits: 65536 prefixes per class
_CHUNK = 1024  # copies of a row emitted at one place


def hash_order(id_column: str, seed: int) -> Column:
    """md5 of ``id-seed``: a shuffle order any engine can reproduce."""
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f"-{seed}")))


def _class_key(group: str | None) -> Column:
    if group is None:
        return F.lit("all")
    # a map key must not be NULL; a NULL class is a class of its own
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null"))


def hash_rank_cut(
    df: DataFrame, id_column: str, seed: int, group: str | None, target: Column
) -> tuple[DataFrame, DataFrame]:
    """Find the hash prefix in which each class reaches its target rank.

    ``target`` may use ``class_size``, ``n_classes`` and ``n_rows``. Returns (df
    with class, hash and prefix, one cut per class): rows with a prefix below
    ``_edge`` are in, rows on the edge have to be ranked, rows above it are out.
    The cuts are a stored table, so that their size is known when the join with
    them is planned: few classes are broadcast, very many are not.
    """
    marked = df.withColumns({"_class": _class_key(group), "_hash": hash_order(id_column, seed)})
    marked = marked.withColumn("_prefix", F.substring("_hash", 1, _PREFIX))
    per_prefix = materialise(marked.groupBy("_class", "_prefix").agg(F.count(F.lit(1)).alias("n")))

    sizes = per_prefix.groupBy("_class").agg(F.sum("n").alias("class_size"))
    totals = sizes.agg(F.struct(F.sum("class_size").alias("n_rows"), F.count("_class").alias("n_classes"))).scalar()
    # at most 16 ^ _PREFIX counts per class
    upto = Window.partitionBy("_class").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    goals = per_prefix.withColumns(
        {
            "class_size": F.sum("n").over(Window.partitionBy("_class")),
            "reached": F.sum("n").over(upto),
            "n_rows": totals["n_rows"],
            "n_classes": totals["n_classes"],
        }
    ).withColumn("target", target.cast("long"))
    below = F.col("reached") < F.col("target")
    cuts = goals.groupBy("_class").agg(
        *[F.max(c).alias(f"_{c}") for c in ("target", "class_size", "n_rows", "n_classes")],
        # first prefix that reaches the target; NULL when the class is too small
        F.min(F.when(~below, F.col("_prefix"))).alias("_edge"),
        F.coalesce(F.max(F.when(below, F.col("reached"))), F.lit(0)).alias("_before"),
    )
    return marked, materialise(cuts)


def _below_edge() -> Column:
    return F.col("_edge").isNull() | (F.col("_prefix") < F.col("_edge"))


def _ranked_edge(marked: DataFrame, cuts: DataFrame, id_column: str) -> DataFrame:
    """Rank only the rows of the prefix in which a class reaches its target."""
    edges = cuts.filter("_target > 0 AND _edge IS NOT NULL").withColumnRenamed("_edge", "_prefix")
    order = Window.partitionBy("_class").orderBy("_hash", id_column)
    rows = marked.join(edges, ["_class", "_prefix"])
    return rows.withColumn("_rank", F.row_number().over(order) + F.col("_before"))


def _first_rows(df: DataFrame, id_column: str, seed: int, group: str | None, target: Column) -> DataFrame:
    marked, cuts = hash_rank_cut(df, id_column, seed, group, target)
    inside = marked.join(cuts, "_class").filter(_below_edge())
    edge = _ranked_edge(marked, cuts, id_column).filter(F.col("_rank") <= F.col("_target"))
    return inside.select(*df.columns).unionByName(edge.select(*df.columns))


def stratified_sample(
    df: DataFrame, proportion: float, id_column: str, group: str | None = None, seed: int = 42
) -> DataFrame:
    """Without replacement, exactly ceil(proportion * n) rows of every class."""
    if not 0 < proportion <= 1:
        raise ValueError("proportion must be in (0, 1]")
    return _first_rows(df, id_column, seed, group, F.ceil(F.lit(float(proportion)) * F.col("class_size")))


def balance_sample(df: DataFrame, id_column: str, label: str, seed: int = 42) -> DataFrame:
    """Give every class the same size, about (rows / classes).

    A larger class loses its last rows in hash order; every row of a smaller
    class is repeated, and its first rows once more until the size is met.
    The result carries ``copy_no`` (1 = original).
    """
    goal = F.ceil(F.col("n_rows") / F.col("n_classes"))
    # the rows that get one copy more than the others of their class
    extra = F.when(goal <= F.col("class_size"), goal).otherwise(goal % F.col("class_size"))
    marked, cuts = hash_rank_cut(df, id_column, seed, label, extra)
    stored_goal = F.ceil(F.col("_n_rows") / F.col("_n_classes"))
    size = F.col("_class_size")
    every = F.when(stored_goal <= size, 0).otherwise(F.floor(stored_goal / size))
    # a class whose goal is a multiple of its size has nothing to rank
    no_extra = F.col("_target") == 0
    off_edge = no_extra | F.col("_edge").isNull() | (F.col("_prefix") != F.col("_edge"))
    one_more = F.when(~no_extra & _below_edge(), 1).otherwise(0)
    settled = marked.join(cuts, "_class").filter(off_edge).withColumn("_copies", every + one_more)
    ranked = _ranked_edge(marked, cuts, id_column)
    edge = ranked.withColumn("_copies", every + (F.col("_rank") <= F.col("_target")).cast("int"))

    columns = [*df.columns, "_copies"]
    sized = settled.select(*columns).unionByName(edge.select(*columns))
    return repeat_rows(sized, "_copies", "copy_no", [id_column])


def repeat_rows(df: DataFrame, copies: str, number: str, spread_by: list[str]) -> DataFrame:
    """Emit each row ``copies`` times, numbered from 1.

    Rows of one chunk grow where they are; only those of several are spread by chunk before they grow.
    """
    chunks = F.sequence(F.lit(1).cast("long"), F.floor((F.col(copies) - 1) / _CHUNK))
    here = df.filter(F.col(copies) > 0).withColumn("_chunk", F.lit(0).cast("long"))
    further = df.filter(F.col(copies) > _CHUNK).withColumn("_chunk", F.explode(chunks)).repartition(*spread_by, "_chunk")
    spread = here.unionByName(further)
    first = F.col("_chunk") * _CHUNK + 1
    last = F.least(first + _CHUNK - 1, F.col(copies).cast("long"))
    return spread.withColumn(number, F.explode(F.sequence(first, last))).drop(copies, "_chunk")

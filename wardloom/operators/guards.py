"""Guards that run with the query: no job while the plan is built, no second scan. A broken rule stops the query, and is shown.

The functions of the same kind in ``relational`` and ``evaluation`` check first and raise ``ValueError`` at once; these are
their lazy forms. A guard looks at the rows that the query reads: where nothing needs a table, nothing in it is checked.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def _shown(on: Iterable[str]) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in on)), F.lit(")"))


def _keys_known(on: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"`{c}`").isNotNull() for c in on))


def stop_where(df: DataFrame, broken: Column, message: Column) -> DataFrame:
    """The same rows; one where ``broken`` is true stops the query."""
    return df.where(F.when(broken, F.raise_error(message)).otherwise(F.lit(True)))


def once(df: DataFrame, on: list[str], what: str) -> DataFrame:
    """The same rows; a key of two rows stops the query. Rows are counted over the key's own shuffle, which a join on the
    key needs anyway; keys with a null count like others."""
    counted = df.withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy(*on)))
    message = F.concat(F.lit(f"{what} has "), F.col("__rows").cast("string"), F.lit(" rows for the key "), _shown(on))
    return stop_where(counted, F.col("__rows") > 1, message).drop("__rows")


def join_unique(df: DataFrame, source: DataFrame, on: list[str], how: str = "inner", what: str = "source") -> DataFrame:
    """A join with a table of one row for each key; a repeated key stops the query. Rows of the table with a null in the
    key, which no row meets, are not looked at."""
    return df.join(once(source.where(_keys_known(on)), on, what), on, how)


def join_required(df: DataFrame, source: DataFrame, on: list[str], what: str = "source") -> DataFrame:
    """An inner join in which every row must find its one partner; one without, a null key too, stops the query."""
    joined = df.join(once(source.where(_keys_known(on)), on, what).withColumn("__there", F.lit(True)), on, "left")
    return stop_where(joined, F.col("__there").isNull(), F.concat(F.lit(f"{what} has no row for the key "), _shown(on))).drop("__there")


def join_one_to_one(df: DataFrame, source: DataFrame, on: list[str], what: str = "source") -> DataFrame:
    """A left join of two tables of one row for each key; a repeated key of either side stops the query."""
    return join_unique(once(df, on, f"the left side of {what}"), source, on, "left", what)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The same rows; none at all stop the query. The guard reads up to one row of the same plan, whose shuffles are shared."""
    none = df.select(F.lit(1).alias("__one")).limit(1).agg(F.count("*").alias("__n"))
    stopped = stop_where(none, F.col("__n") == 0, F.lit(f"{what}: 0 rows")).where("__n > 1")
    return df.unionByName(stopped.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema)))


def require_known(df: DataFrame, column: str) -> DataFrame:
    """The same rows; one where the column is null stops the query."""
    return stop_where(df, F.col(f"`{column}`").isNull(), F.lit(f"a row has no {column}"))


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and counts of them that are there after the query: ``n_rows`` and others, aggregates without a
    distinct. ``observation.get`` waits for the first action; the rows pass once."""
    observation = Observation()
    return df.observe(observation, F.count(F.lit(1)).alias("n_rows"), *(c.alias(n) for n, c in metrics.items())), observation


def warnings(df: DataFrame, wanted: Iterable[str]) -> tuple[list[str], dict[str, Column]]:
    """For columns that a caller asks for: what can be said from the schema at once (a column that is not there), and for
    the others the metrics for ``observed`` that tell how many rows have a value (``known_<column>``)."""
    wanted = list(dict.fromkeys(wanted))
    missing = [f"column {c!r} was asked for and is not there" for c in wanted if c not in df.columns]
    return missing, {f"known_{c}": F.count_if(F.col(f"`{c}`").isNotNull()) for c in wanted if c in df.columns}

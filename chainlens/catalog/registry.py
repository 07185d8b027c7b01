"""Registration of queries and their SQL with equal rounding on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# The same queries without rounding, for timing.
RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _rounded(x: Column, digits: int) -> Column:
    """Significant digits; sums differ in the last bits by order of addition."""
    text = F.format_string(f"%.{digits - 1}e", x)
    return F.when(x == 0, 0.0).when(x.isNotNull(), text.cast("double"))


def round_doubles(df: DataFrame, digits: int = 9) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[
        _rounded(F.col(c), digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def add(name: str, sql: str | None = None, doubles: str = "", digits: int = 9):
    """Register a query; ``doubles`` names the double columns of the SQL result."""

    def register(function):
        RAW[name] = function
        QUERIES[name] = lambda spark, path: round_doubles(function(spark, path), digits)
        if sql is not None:
            swaps = ", ".join(
                f"CASE WHEN {c} = 0 THEN CAST(0 AS DOUBLE) ELSE"
                f" CAST(printf('%.{digits - 1}e', CAST({c} AS DOUBLE)) AS DOUBLE) END AS {c}" for c in doubles.split())
            ORACLE[name] = f"SELECT * REPLACE ({swaps}) FROM ({sql})" if swaps else sql
        return function

    return register


# -- shapes made from the given tables ---------------------------------------

LI = ["qty", "price", "disc", "tax"]
EV = ["val", "root", "k"]


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def li_chain(spark: SparkSession, path: str) -> DataFrame:
    """Unordered wide sample: four parameters, four chains, a weight."""
    return table(spark, path, "lineitem").select(
        (F.col("l_suppkey") % 4).cast("int").alias("chain_id"), F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        (F.lit(1.0) + F.col("l_linenumber") / 10.0).alias("Weight"))


LI_SQL = """ch AS (SELECT CAST(l_suppkey % 4 AS INTEGER) AS chain_id, l_quantity AS qty, l_extendedprice AS price,
 l_discount AS disc, l_tax AS tax, CAST(1.0 + l_linenumber / 10.0 AS DOUBLE) AS Weight FROM lineitem)"""


def ev_chain(spark: SparkSession, path: str, chains: int = 1) -> DataFrame:
    """Chain ordered by step = event_id, without gaps when there is one chain."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    return table(spark, path, "events").select(
        (F.col("user_id") % chains).cast("int").alias("chain_id"), F.col("event_id").alias("step"),
        F.col("value").alias("val"), F.sqrt("value").alias("root"), k.alias("k"),
        (F.lit(1.0) + k / 100.0).alias("Weight"), F.col("event_type"))


def ev_sql(chains: int = 1) -> str:
    return f"""ev0 AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k0 FROM events),
 ch AS (SELECT CAST(user_id % {chains} AS INTEGER) AS chain_id, event_id AS step, value AS val,
 sqrt(value) AS root, k0 AS k, CAST(1.0 + k0 / 100.0 AS DOUBLE) AS Weight, event_type FROM ev0)"""


def long_sql(columns, keys: str = "", source: str = "ch", weight: str = "1.0", where: str = "") -> str:
    """Rows (keys, param, value, w) of the columns."""
    keys = f"{keys}, " if keys else ""
    where = f" WHERE {where}" if where else ""
    return " UNION ALL ".join(
        f"SELECT {keys}'{c}' AS param, CAST({c} AS DOUBLE) AS value, CAST({weight} AS DOUBLE) AS w FROM {source}{where}"
        for c in columns)


def hist_sql(columns, nbins: int | str = 70, keys: str = "", source: str = "ch", weight: str = "1.0",
             ranges: str | None = None, where: str = "") -> str:
    """CTEs that end in ``hist`` (keys, param, bin, lo, hi, content), empty bins included."""
    k = f"{keys}, " if keys else ""
    rng = ranges or "SELECT param, min(value) AS a, max(value) AS b FROM lng GROUP BY param"
    on = " AND ".join(f"g.{c.strip()} = c.{c.strip()}" for c in [*keys.split(","), "param", "bin"] if c.strip())
    g_keys = "".join(f"g.{c.strip()}, " for c in keys.split(",") if c.strip())
    return f"""lng AS ({long_sql(columns, keys, source, weight, where)}), rng AS ({rng}),
 cnt AS (SELECT {k}lng.param, CAST(least(floor({nbins} * (value - a) / (b - a)), {nbins} - 1) AS INTEGER) AS bin,
   sum(w) AS content FROM lng JOIN rng ON lng.param = rng.param WHERE value >= a AND value < b GROUP BY ALL),
 grid AS (SELECT {k}t.param, CAST(i.range AS INTEGER) AS bin, a + i.range * ((b - a) / {nbins}) AS lo,
   a + (i.range + 1) * ((b - a) / {nbins}) AS hi FROM (SELECT DISTINCT {k}param FROM cnt) t
   JOIN rng ON t.param = rng.param, range({nbins}) i),
 hist AS (SELECT {g_keys}g.param, g.bin, g.lo, g.hi, coalesce(c.content, 0.0) AS content
   FROM grid g LEFT JOIN cnt c ON {on})"""


def event_sample(spark: SparkSession, path: str) -> DataFrame:
    """Weighted events of three samples with mode, channel and two kinematic variables."""
    part = table(spark, path, "part").select(
        F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 3).cast("int").alias("sample_id"))
    return table(spark, path, "lineitem").join(part, "l_partkey").select(
        "sample_id", F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("channel"),
        F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"),
        (F.lit(1.0) - F.col("l_discount")).alias("w0"), F.col("l_suppkey").alias("toy"), F.col("l_tax").alias("tax"))


SAMPLE_SQL = """es AS (SELECT CAST(p_size % 3 AS INTEGER) AS sample_id, l_returnflag AS mode, l_linestatus AS channel,
 l_quantity AS x, l_extendedprice AS y, CAST(1.0 AS DOUBLE) - l_discount AS w0, l_suppkey AS toy, l_tax AS tax
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""

X_EDGES = [0.5 + 5 * i for i in range(11)]
X_BIN_SQL = "CAST(floor((x - 0.5) / 5) AS INTEGER)"
AXES = [{"sample_id": s, "dim": 0, "var": "x", "edges": X_EDGES} for s in range(3)]


def toy_sql(extra: str = "") -> str:
    """Toys and data with every bin, 0 where nothing fell; with a further key, every cell that any toy fills."""
    keys = "sample_id" + extra + ", bin"
    cells = (f"SELECT DISTINCT {keys} FROM seen" if extra else
             "SELECT CAST(s.range AS INTEGER) AS sample_id, CAST(b.range AS INTEGER) AS bin FROM range(3) s, range(10) b")
    return f"""{SAMPLE_SQL}, seen AS (SELECT toy, sample_id{extra}, {X_BIN_SQL} AS bin, sum(w0) AS mc, sum(w0 * w0) AS w2 FROM es GROUP BY ALL),
 cells AS ({cells}), every_toy AS (SELECT DISTINCT toy FROM es),
 toys AS (SELECT toy, {keys}, coalesce(mc, 0.0) AS mc, coalesce(w2, 0.0) AS w2 FROM (SELECT * FROM every_toy, cells) LEFT JOIN seen USING (toy, {keys})),
 hits AS (SELECT sample_id, {X_BIN_SQL} AS bin, count(*) AS n FROM es GROUP BY ALL),
 dat AS (SELECT s.range::INTEGER AS sample_id, b.range::INTEGER AS bin, CAST(ceil(coalesce(n, 0) / (SELECT count(*) FROM every_toy)) AS DOUBLE) AS data
   FROM range(3) s, range(10) b LEFT JOIN hits ON hits.sample_id = s.range AND hits.bin = b.range)"""

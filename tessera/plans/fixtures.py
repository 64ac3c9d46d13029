"""Scene items derived from the driver tables. Each text is valid in Spark SQL and in DuckDB; {name} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kinds as K

TRUTH = """
SELECT slide_id, concat('gt-', CAST(n AS STRING)) AS id, n AS ord, p, u, f, kind, x0, y0, x0 + w AS x1, y0 + h AS y1, score, tax, concat('n', CAST(p % 4 AS STRING)) AS att1, concat('n', CAST(u % 5 AS STRING)) AS att2, p % 3 = 0 AS attached
FROM (SELECT slide_id, n, p, u, f, kind, x0, y0, CASE WHEN kind = 'arrow' AND p % 2 = 0 THEN h0 ELSE w0 END AS w, CASE WHEN kind = 'arrow' AND p % 2 = 0 THEN w0 ELSE h0 END AS h, score, tax
  FROM (SELECT l_orderkey AS slide_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS n,
      l_partkey AS p, l_suppkey AS u, l_returnflag AS f, CASE WHEN l_partkey % 11 = 0 THEN 'textbox' WHEN l_linestatus = 'O' THEN 'box' ELSE 'arrow' END AS kind,
      CAST((l_partkey * 37 + l_suppkey * 53) % 1000 AS DOUBLE) AS x0, CAST((l_suppkey * 53 + l_linenumber * 97) % 700 AS DOUBLE) AS y0,
      40 + 4 * l_quantity AS w0, CASE WHEN l_linestatus = 'O' THEN CAST(30 + l_partkey % 90 AS DOUBLE) ELSE CAST(6 AS DOUBLE) END AS h0, 1 - l_discount AS score, l_tax AS tax
    FROM {lineitem}) q0) q
"""
LAST_TIE = "l_shipdate, l_extendedprice"
#: Lines a task of by_slide() holds.
LINES = 25_000
#: Jittered copies in five stages, with some lost; every ninth kind differs and every seventh attachment.
ARTIFACTS = f"""
SELECT slide_id, stage, k, concat('a-', CAST(ord AS STRING)) AS id, ord, CASE WHEN (p + k) % 9 = 0 THEN 'rounded_rect' WHEN kind = 'box' THEN 'container' WHEN kind = 'textbox' THEN 'textbox' ELSE 'connector' END AS kind,
  x0 + dx AS x0, y0 + dy AS y0, x1 + dx + ex AS x1, y1 + dy AS y1, score, tax < CAST(0.08 AS DOUBLE) AS evaluable, f,
  CASE WHEN (u + k) % 7 = 0 THEN 'n9' ELSE att1 END AS att1, att2, attached
FROM (SELECT g.*, st.k, st.stage, CAST((p + 11 * k) % 31 - 15 AS DOUBLE) AS dx, CAST((u + 7 * k) % 17 - 8 AS DOUBLE) AS dy, CASE WHEN (p + k) % 13 = 0 THEN CAST(160 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS ex
  FROM ({TRUTH}) g CROSS JOIN (VALUES (0, '01_geometry_raw'), (1, '02_guides'), (2, '03_objects'), (3, '05_selection'), (4, '07_emit')) AS st(k, stage)
  WHERE (u + 3 * ord + k) % 6 <> 0) z
"""
#: Text regions: one in four lines, small boxes near the line's box.
TEXTS = f"""
SELECT slide_id, concat('text:', CAST(ord AS STRING)) AS id, ord, CASE WHEN p % 5 = 0 THEN NULL ELSE concat('t', CAST(p AS STRING)) END AS text, x0 + 8 AS x0, y0 + 4 AS y0, x0 + 48 + CAST(u % 40 AS DOUBLE) AS x1, y0 + 20 AS y1 FROM ({TRUTH}) g WHERE (p + u) % 4 = 0
"""
#: Segments with two ends and a confidence.
SEGMENTS = f"""
SELECT slide_id, concat('s-', CAST(ord AS STRING)) AS id, ord, x0 AS xa, y0 AS ya, CASE WHEN p % 3 = 0 THEN x0 + 2 ELSE x1 END AS xb, CASE WHEN p % 3 = 0 THEN y1 ELSE y0 + CAST(u % 4 AS DOUBLE) END AS yb, CAST(40 + u % 50 AS DOUBLE) / 100 AS confidence FROM ({TRUTH}) g
"""
#: Counters as an evaluation leaves them: one row an order and event type.
ITERATIONS = """
SELECT concat('slide-', CAST(user_id AS STRING)) AS slide, concat('iter_', CAST(event_id % 13 AS STRING)) AS iteration, event_type AS stage, CAST(floor(value) AS BIGINT) AS n, value, CAST(event_id AS BIGINT) AS ord,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END AS grow, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 3 = 0 END AS motifs, props FROM {events}
"""


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def boxed(df: DataFrame) -> DataFrame:
    return df.withColumn("box", G.box("x0", "y0", "x1", "y1"))


def attached(df: DataFrame) -> DataFrame:
    return df.withColumn("attachment_ids", F.when(F.col("attached"), F.array("att1", "att2")).otherwise(F.array().cast("array<string>")))


def with_sources(df: DataFrame) -> DataFrame:
    """Source ids by flag: R is geometry, A geometry and fallback, N fallback only in every second row, else neither."""
    ids = F.when(F.col("f") == "R", F.array(F.lit("rect-candidate:x"))).when(F.col("f") == "A", F.array(F.lit("grow_fallback"), F.lit("rect-candidate:x"))).when((F.col("f") == "N") & (F.col("ord") % 2 == 0), F.array(F.lit("grow_fallback"))).otherwise(F.array(F.lit("vlm:x")))
    return df.withColumn("source_ids", ids)


def _truth(rows: DataFrame) -> DataFrame:
    return attached(boxed(rows)).withColumn("evaluable", F.lit(True)).withColumn("bucket", F.lit("other"))


def _artifacts(rows: DataFrame) -> DataFrame:
    rows = with_sources(attached(boxed(rows)))
    return rows.withColumn("bucket", K.bucket(F.col("source_ids")))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(frame(spark, sf_dir, TRUTH))


def artifacts(spark: SparkSession, sf_dir: str, stage: str | None = None) -> DataFrame:
    rows = _artifacts(frame(spark, sf_dir, ARTIFACTS))
    return rows if stage is None else rows.where(F.col("stage") == stage)


#: Columns of a line that packed() puts into longs: name, bits at most, units in one.
PACKED = [
    ("l_extendedprice", 32, 100), ("l_partkey", 31, 1), ("l_suppkey", 24, 1), ("l_linenumber", 8, 1), ("l_quantity", 8, 1), ("l_discount", 8, 100), ("l_tax", 8, 100),
    ("l_shipdate", 24, "date"), ("l_returnflag", 8, "char"), ("l_linestatus", 8, "char"),
]


def _units(name: str, unit: int | str) -> Column:
    c = F.col(name)
    return (F.unix_date(c.cast("date")) if unit == "date" else F.ascii(c) if unit == "char" else c if unit == 1 else F.round(c * F.lit(unit))).try_cast("long")


def _value(n: Column, unit: int | str, kind: str) -> Column:
    return (F.date_from_unix_date(n.cast("int")) if unit == "date" else F.char(n) if unit == "char" else n if unit == 1 else n.cast("double") / F.lit(unit)).cast(kind)


def _measured(lines: DataFrame) -> DataFrame:
    """Lines with their values in units, named _{name}; null where a value would not come back equal."""
    kinds, names = dict(lines.dtypes), ["l_orderkey", *(name for name, _, _ in PACKED)]
    rows = lines.select(*names, *(_units(name, unit).alias(f"_{name}") for name, _, unit in PACKED))
    same = lambda n, name, bits, unit: n.between(0, 2**bits - 1) & (_value(n, unit, kinds[name]) == F.col(name))
    return rows.select(*names, *(F.when(same(F.col(f"_{name}"), name, bits, unit), F.col(f"_{name}")).alias(f"_{name}") for name, bits, unit in PACKED))


def bounds_of(lines: DataFrame) -> tuple[int, dict[str, tuple[int, int]]]:
    """The count of lines, and the least and the greatest units of each packed column."""
    ends = [f(f"_{name}").alias(f"{end}_{name}") for name, _, _ in PACKED for end, f in (("low", F.min), ("high", F.max))]
    found = _measured(lines).agg(F.count("*").alias("n"), *ends).na.fill(0).first()
    return found["n"], {name: (found[f"low_{name}"], found[f"high_{name}"]) for name, _, _ in PACKED}


def _places(bounds: dict[str, tuple[int, int]] | None) -> tuple[list[tuple[str, int | str, int, int, int, int]], int]:
    """Name, unit, least and greatest units, bits and first bit of each packed column, and all bits. Without bounds they have the bits that PACKED allows."""
    places, at = [], 0
    for name, most, unit in PACKED:
        low, high = (0, 2**most - 1) if bounds is None else bounds[name]
        places.append((name, unit, low, high, (high - low).bit_length(), at))
        at += places[-1][4]
    return places, at


def packed(lines: DataFrame, bounds: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Lines as l_orderkey and, bit by bit, as few longs as their bounds need, which take some four tenths in a shuffle. Lines with a value out of bounds, or one that would not come back equal, keep all their columns in `plain`.

    The last long is filled from its top and stands first: its zeros then join those around the key, and compress as one run."""
    places, bits = _places(bounds)
    longs = [F.lit(0).cast("long") for _ in range(-(-bits // 64))]
    for name, _, low, _, wide, at in places:
        n, (i, shift) = F.col(f"_{name}") - F.lit(low), divmod(at, 64)
        if wide:
            longs[i] = longs[i].bitwiseOR(F.shiftleft(n, shift))
        if shift + wide > 64:
            longs[i + 1] = longs[i + 1].bitwiseOR(F.shiftright(n, 64 - shift))
    if longs:
        longs[-1] = F.shiftleft(longs[-1], -bits % 64)
    same = F.lit(True)
    for name, _, low, high, _, _ in places:
        same &= F.coalesce(F.col(f"_{name}").between(low, high), F.lit(False))
    rows = _measured(lines).withColumn("_same", same)
    columns = [F.when(F.col("_same"), long).alias(f"long{i}") for i, long in enumerate(longs)]
    return rows.select(*reversed(columns), "l_orderkey", F.when(~F.col("_same"), F.struct(*(name for name, _, _ in PACKED))).alias("plain"))


def unpacked(rows: DataFrame, kinds: dict[str, str], bounds: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The lines that packed() was given, with the same bounds; `kinds` are their types."""
    places, bits = _places(bounds)
    longs = [F.col(f"long{i}") for i in range(-(-bits // 64))]
    if longs:
        longs[-1] = F.shiftrightunsigned(longs[-1], -bits % 64)
    columns = []
    for name, unit, low, _, wide, at in places:
        n, (i, shift) = F.lit(low).cast("long"), divmod(at, 64)
        if wide:
            whole = F.shiftrightunsigned(longs[i], shift)
            whole = whole.bitwiseOR(F.shiftleft(longs[i + 1], 64 - shift)) if shift + wide > 64 else whole
            n = whole.bitwiseAND(F.lit(2**wide - 1).cast("long")) + n
        columns.append(F.when(F.col("plain").isNull(), _value(n, unit, kinds[name])).otherwise(F.col(f"plain.{name}")).alias(name))
    return rows.select("l_orderkey", *columns)


def by_slide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """truth() and artifacts() dealt by slide in one exchange that both read: lines that tie in TRUTH's order go on by their other columns, so neither side reads fewer of them.

    Partitions follow the count of lines, so that what a task sorts (some ten pairs a line) stays in memory, however many lines there are.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    count, bounds = bounds_of(lines)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // LINES))
    lines = unpacked(packed(lines, bounds).repartition(parts, "l_orderkey"), dict(lines.dtypes), bounds)
    whole = lambda sql: spark.sql(sql.replace(LAST_TIE, f"{LAST_TIE}, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"), lineitem=lines)
    return _truth(whole(TRUTH)), _artifacts(whole(ARTIFACTS))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxed(frame(spark, sf_dir, TEXTS))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, SEGMENTS).withColumn("a", G.point(F.col("xa"), F.col("ya"))).withColumn("b", G.point(F.col("xb"), F.col("yb")))

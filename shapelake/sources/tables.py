"""Shape tables derived from the given tables: outlines, polylines, clicks, operation logs, rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each statement runs in Spark SQL and DuckDB alike; {grid} is a 32 by 32 grid.
OUTLINES = """
with k as (select user_id outline_id, row_number() over (partition by user_id order by ts, event_id) - 1 seq,
  count(*) over (partition by user_id) n, value from events)
select outline_id, seq, (10 + value) * cos(2 * pi() * seq / n) x, (10 + value) * sin(2 * pi() * seq / n) y, value from k"""

POLYLINES = """
with k as (select o_custkey line_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 seq,
  o_totalprice from orders)
select line_id, seq, 10.0e0 * seq x, o_totalprice / 1000 y from k"""

CLICKS = """
select user_id session_id, row_number() over (partition by user_id order by ts, event_id) click_seq, event_type,
  value * 10 x, cast(regexp_extract(props, '([0-9]+)', 1) as double) * 10 y from events"""

OP_LOG = """
select user_id session_id, row_number() over (partition by user_id order by ts, event_id) event_seq,
  case event_type when 'error' then 'undo' when 'signup' then 'redo' else 'commit' end action,
  case event_type when 'click' then 'triangle' when 'view' then 'shape' when 'purchase' then 'line' end kind,
  value measure from events"""

_DARK = "(x-16)*(x-16)*(1+s_suppkey%3)+(y-15)*(y-15)*(1+s_suppkey%2) <= 90+10*(s_suppkey%5)"
PIXELS = f"""
select s_suppkey image_id, cast(x as int) x, cast(y as int) y,
  cast((case when {_DARK} then 60 else 220 end) + (x*7+y*13+s_suppkey*31)%11 as int) r,
  cast((case when {_DARK} then 90 else 225 end) + (x*5+y*3+s_suppkey*17)%7 as int) g,
  cast((case when {_DARK} then 40 else 230 end) + (x*3+y*11+s_suppkey*7)%5 as int) b
from supplier cross join {{grid}}"""
SPARK_GRID = "(select id x from range(32)) cross join (select id y from range(32))"
DUCK_GRID = "(select range x from range(32)) a cross join (select range y from range(32)) b"
#: Dark blob with specks, holes and thin corridors.
MASK = "(r < 150 or (x*31+y*17+image_id)%23 = 0) and (x+y+image_id)%13 <> 0"
#: The blob alone.
BLOB = "r < 150"

SPECIMENS = """
select s_suppkey image_id, s_suppkey seq,
  case when s_suppkey % 4 = 0 then '  ' when s_suppkey % 2 = 1 then s_name end name from supplier"""


def _views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OUTLINES.replace("from events", "from {events}"), **_views(spark, sf_dir, "events"))


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POLYLINES.replace("from orders", "from {orders}"), **_views(spark, sf_dir, "orders"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CLICKS.replace("from events", "from {events}"), **_views(spark, sf_dir, "events"))


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OP_LOG.replace("from events", "from {events}"), **_views(spark, sf_dir, "events"))


def specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPECIMENS.replace("from supplier", "from {supplier}"), **_views(spark, sf_dir, "supplier"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = PIXELS.replace("from supplier", "from {supplier}").replace("{grid}", SPARK_GRID)
    return spark.sql(text, **_views(spark, sf_dir, "supplier"))


def masks(spark: SparkSession, sf_dir: str, condition: str = MASK) -> DataFrame:
    """image_id, x, y of the pixels inside."""
    return pixels(spark, sf_dir).where(condition).select("image_id", "x", "y")


def landmark_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of 64 vertices from the packed radii of embeddings."""
    packed = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = packed.select(F.col("vec_id").alias("outline_id"), F.posexplode("embedding").alias("seq", "radius"))
    angle = 2 * F.pi() * F.col("seq") / 64
    radius = 2 + F.col("radius").cast("double")
    return rows.select("outline_id", "seq", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))

"""The driver's tables seen as detector tables (projections only, so filters and pruning reach the scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream; the table may be one file or a folder of files.

    A pattern that only this name matches lists either; a filter on file names would pass over the files of a folder.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def trig(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Trigger records from ``events``: run, event, ts (40 MHz ticks), q17, trigger, nhit."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    # one trigger word per kind of event plus three macro bits from the multiplicity
    base = (
        F.when(F.col("event_type") == "view", 1)
        .when(F.col("event_type") == "click", 1048833)
        .when(F.col("event_type") == "purchase", 33558529)
        .when(F.col("event_type") == "signup", 112)
        .otherwise(48)
    )
    return e.select(
        (F.col("user_id") % 8).alias("run"),
        F.col("event_id").alias("event"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 40).alias("ts"),
        F.col("value").alias("q17"),
        (base.cast("long") + (k % 4) * 65536).alias("trigger"),
        k.alias("nhit"),
    )


#: events share the vertices and tracks of this many vectors
SLOTS = 128


def trig_frame(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Trigger records with a vertex and a track each, from ``embeddings``: x, y, z, vertex_ok, entrance e*, exit x*, converged."""
    v = [F.get("embedding", F.lit(i)).cast("double") for i in range(11)]
    on_sphere = lambda k, name: [(850.0 * v[k + i] / F.sqrt(v[k] ** 2 + v[k + 1] ** 2 + v[k + 2] ** 2)).alias(f"{name}{c}") for i, c in enumerate("xyz")]
    slots = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < SLOTS).select(
        F.col("vec_id").alias("slot"), *[(3000.0 * v[i]).alias(c) for i, c in enumerate("xyz")], (v[9] > -0.1).alias("vertex_ok"),
        *on_sphere(3, "e"), *on_sphere(6, "x"), (v[10] > -0.05).alias("converged"))
    t = trig(spark, sf_dir, read)
    return t.join(slots, F.col("event") % SLOTS == F.col("slot"), "left").drop("slot")


def _hits(li: DataFrame, run, event) -> DataFrame:
    found = F.col("l_discount") >= 0.01
    return li.select(
        run.alias("run"),
        event.alias("event"),
        (F.col("l_partkey") % 2126).alias("cable"),
        (F.col("l_linenumber") % 2).cast("long").alias("atwd"),
        (F.col("l_quantity").cast("long") % 3).alias("gain"),
        F.when(found, F.col("l_extendedprice") / 100).alias("t"),
        F.col("l_quantity").alias("q"),
        (F.col("l_quantity") * 16 + F.col("l_linenumber")).alias("adc"),
        (F.col("l_quantity") >= 48).alias("saturated"),
        found.alias("found"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit per line item; an event is an order (a handful of hits)."""
    li = table(spark, sf_dir, "lineitem")
    return _hits(li, F.col("l_orderkey") % 8, F.col("l_orderkey"))


def showers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit per line item; an event is a supplier (hundreds of hits, like a bright event)."""
    li = table(spark, sf_dir, "lineitem")
    return _hits(li, F.col("l_suppkey") % 8, F.col("l_suppkey"))


def waves(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Waveforms from ``embeddings``: samples in ADC counts, one channel per label."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("wf_id"),
        F.col("label").cast("long").alias("cable"),
        (F.col("vec_id") % 2).alias("atwd"),
        (F.col("vec_id") % 4).alias("gain"),
        (F.col("vec_id") % 5 - 2).alias("launch"),
        F.transform("embedding", lambda v: 100 * v.cast("double")).alias("samples"),
    )


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel calibration from ``part``: one row per (cable, atwd), at most 2 x 2126 rows."""
    p = table(spark, sf_dir, "part")
    return p.groupBy((F.col("p_partkey") % 2126).alias("cable"), (F.col("p_size") % 2).cast("long").alias("atwd")).agg(
        (F.lit(1.4) + F.min("p_size") / 200).alias("bin_ns"),
        (F.lit(10) + F.max("p_size")).cast("double").alias("q1pe"),
        (F.max("p_size") / 8 - 3).alias("t0"),
    )


def run_comment(o: DataFrame) -> DataFrame:
    """Run-list columns per order, with shifter comments in eight styles."""
    key, num = F.col("o_orderkey"), F.col("o_custkey") % 1400
    metres = F.format_string("%d.%02d", (num / 100).cast("int"), (num % 100).cast("int"))
    sign = F.when(key % 3 == 0, "-").otherwise("+")
    kind = key % 8
    comment = (
        F.when(kind == 0, F.concat(F.lit("Ge68 "), sign, metres, F.lit(" m")))
        .when(kind == 1, F.concat(F.lit("Co60 in balloon center "), metres))
        .when(kind == 2, F.concat(F.lit("Co-60 source - -"), (num % 9).cast("string"), F.lit("m")))
        .when(kind == 3, F.concat(sign, num.cast("string"), F.lit(" cm  zn 65")))
        .when(kind == 4, F.concat(F.lit("normal run veto( start ~ "), key.cast("string"), F.lit(")")))
        .when(kind == 5, F.concat(F.lit("co 60 run, "), num.cast("string"), F.lit("' PMTs off")))
        .when(kind == 6, F.concat(F.lit("HV down -> veto("), key.cast("string"), F.lit(" ~ end) then VETO(3~"),
                                  num.cast("string"), F.lit(")")))
        .otherwise(F.concat(F.repeat(F.lit("OD inefficiency "), 14), num.cast("string"), F.lit(" mm")))
    )
    return o.select(
        key.alias("run"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("start"),
        (F.round(F.col("o_totalprice") / 100) / 1000).alias("hours"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000000).cast("long").alias("unix_start"),
        (key % 2).alias("flag"),
        (F.substring("o_orderpriority", 1, 1).cast("long") - 1).alias("grade"),
        comment.alias("comment"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run table from ``orders`` (one run per order)."""
    return run_comment(table(spark, sf_dir, "orders"))


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run table written as text lines; orders in state ``P`` give lines that are not run records."""
    o = table(spark, sf_dir, "orders")
    r = run_comment(o.where("o_orderstatus <> 'P'"))
    line = F.format_string("%06d   %s   %.3f   %d  %d  %d  %s", "run", "start", "hours", "unix_start", "flag", "grade", "comment")
    junk = o.where("o_orderstatus = 'P'").select(F.concat(F.lit("# note "), F.col("o_orderkey").cast("string")).alias("value"))
    return r.select(line.alias("value")).unionAll(junk)


VIEW_SQL = {
    "trig": """trig AS (
  SELECT user_id % 8 AS run, event_id AS event, epoch_us(ts) * 40 AS ts, value AS q17,
         CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1048833 WHEN 'purchase' THEN 33558529
              WHEN 'signup' THEN 112 ELSE 48 END AS BIGINT)
         + (CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) % 4) * 65536 AS trigger,
         CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) AS nhit
  FROM events)""",
    "frame": f"""frame AS (
  SELECT t.*, 3000 * v1 AS x, 3000 * v2 AS y, 3000 * v3 AS z, v10 > -0.1 AS vertex_ok,
         850 * v4 / sqrt(v4 * v4 + v5 * v5 + v6 * v6) AS ex, 850 * v5 / sqrt(v4 * v4 + v5 * v5 + v6 * v6) AS ey, 850 * v6 / sqrt(v4 * v4 + v5 * v5 + v6 * v6) AS ez,
         850 * v7 / sqrt(v7 * v7 + v8 * v8 + v9 * v9) AS xx, 850 * v8 / sqrt(v7 * v7 + v8 * v8 + v9 * v9) AS xy, 850 * v9 / sqrt(v7 * v7 + v8 * v8 + v9 * v9) AS xz,
         v11 > -0.05 AS converged
  FROM trig t LEFT JOIN (SELECT vec_id, {', '.join(f'embedding[{i}]::DOUBLE AS v{i}' for i in range(1, 12))} FROM embeddings WHERE vec_id < {SLOTS}) s
    ON s.vec_id = t.event % {SLOTS})""",
    "hits": """hits AS (
  SELECT l_orderkey % 8 AS run, l_orderkey AS event, l_partkey % 2126 AS cable, CAST(l_linenumber % 2 AS BIGINT) AS atwd,
         CAST(l_quantity AS BIGINT) % 3 AS gain, CASE WHEN l_discount >= 0.01 THEN l_extendedprice / 100 END AS t,
         l_quantity AS q, l_quantity * 16 + l_linenumber AS adc, l_quantity >= 48 AS saturated, l_discount >= 0.01 AS found
  FROM lineitem)""",
    "showers": """showers AS (
  SELECT l_suppkey % 8 AS run, l_suppkey AS event, l_partkey % 2126 AS cable, CAST(l_linenumber % 2 AS BIGINT) AS atwd,
         CAST(l_quantity AS BIGINT) % 3 AS gain, CASE WHEN l_discount >= 0.01 THEN l_extendedprice / 100 END AS t,
         l_quantity AS q, l_quantity * 16 + l_linenumber AS adc, l_quantity >= 48 AS saturated, l_discount >= 0.01 AS found
  FROM lineitem)""",
    "waves": """waves AS (
  SELECT vec_id AS wf_id, CAST(label AS BIGINT) AS cable, vec_id % 2 AS atwd, vec_id % 4 AS gain, vec_id % 5 - 2 AS launch,
         [100 * CAST(v AS DOUBLE) for v in embedding] AS samples FROM embeddings)""",
    "calib": """calib AS (
  SELECT p_partkey % 2126 AS cable, CAST(p_size % 2 AS BIGINT) AS atwd, 1.4 + min(p_size) / 200.0 AS bin_ns,
         CAST(10 + max(p_size) AS DOUBLE) AS q1pe, max(p_size) / 8.0 - 3 AS t0
  FROM part GROUP BY 1, 2)""",
    "sensor": """sensor AS (
  SELECT cable, CASE WHEN cable < 1879 THEN 850.0 ELSE 900.0 END * sqrt(1 - cz * cz) * cos(phi) AS px,
         CASE WHEN cable < 1879 THEN 850.0 ELSE 900.0 END * sqrt(1 - cz * cz) * sin(phi) AS py,
         CASE WHEN cable < 1879 THEN 850.0 ELSE 900.0 END * cz AS pz
  FROM (SELECT cable, 1.0 - (2.0 * i + 1.0) / n AS cz, (i + 0.5) * (pi() * (1.0 + sqrt(5.0))) AS phi
        FROM (SELECT range AS cable, CASE WHEN range < 1879 THEN range ELSE range - 1879 END AS i,
                     CASE WHEN range < 1879 THEN 1879 ELSE 247 END AS n FROM range(2126))))""",
    "runs": """runs AS (
  SELECT o_orderkey AS run, strftime(o_orderdate, '%Y/%m/%d') AS start, round(o_totalprice / 100) / 1000 AS hours,
         CAST(floor(epoch_us(o_orderdate) / 1000000) AS BIGINT) AS unix_start, o_orderkey % 2 AS flag,
         CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 AS grade, o_orderstatus AS status,
         CASE o_orderkey % 8
           WHEN 0 THEN concat('Ge68 ', sgn, m, ' m')
           WHEN 1 THEN concat('Co60 in balloon center ', m)
           WHEN 2 THEN concat('Co-60 source - -', CAST(num % 9 AS VARCHAR), 'm')
           WHEN 3 THEN concat(sgn, CAST(num AS VARCHAR), ' cm  zn 65')
           WHEN 4 THEN concat('normal run veto( start ~ ', CAST(o_orderkey AS VARCHAR), ')')
           WHEN 5 THEN concat('co 60 run, ', CAST(num AS VARCHAR), ''' PMTs off')
           WHEN 6 THEN concat('HV down -> veto(', CAST(o_orderkey AS VARCHAR), ' ~ end) then VETO(3~', CAST(num AS VARCHAR), ')')
           ELSE concat(repeat('OD inefficiency ', 14), CAST(num AS VARCHAR), ' mm') END AS comment
  FROM (SELECT *, o_custkey % 1400 AS num, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '+' END AS sgn,
               concat(CAST((o_custkey % 1400) // 100 AS VARCHAR), '.', lpad(CAST((o_custkey % 1400) % 100 AS VARCHAR), 2, '0')) AS m
        FROM orders))""",
}


def with_views(*names: str) -> str:
    """The start of an oracle statement: ``WITH`` plus the named views."""
    return "WITH " + ",\n".join(VIEW_SQL[n] for n in names)

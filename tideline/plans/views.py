"""Event-shaped views derived from the driver tables, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators.ordered import row_numbers
from tideline.session import scratch_path, stored

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

DUCKDB_VIEWS = {
    "games": """
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR),
                   CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS game_id,
         l_shipdate AS ts, l_returnflag AS league, l_linestatus AS stage,
         CAST(l_suppkey % 30 AS INT) AS home, CAST(l_partkey % 30 AS INT) AS away,
         CAST(l_quantity AS INT) % 10 AS home_score, CAST(ROUND(l_discount * 100) AS INT) AS away_score,
         l_partkey AS k1, l_suppkey AS k2, l_orderkey AS k3
  FROM lineitem WHERE l_suppkey % 30 <> l_partkey % 30""",
    "entity_rows": """
  SELECT game_id, ts, league, stage, home AS entity, away AS opponent, 'H' AS side, home_score AS gf, away_score AS ga,
         k1, k2, k3 FROM games
  UNION ALL
  SELECT game_id, ts, league, stage, away, home, 'A', away_score, home_score, k1, k2, k3 FROM games""",
    "probs": """
  SELECT game_id, ts, league, stage, home, away, home_score, away_score, k1, k2, k3,
         CASE WHEN home_score > away_score THEN 0 WHEN home_score = away_score THEN 1 ELSE 2 END AS y,
         p1 / (p1 + p2 + p3) AS p_home, p2 / (p1 + p2 + p3) AS p_draw, p3 / (p1 + p2 + p3) AS p_away,
         q1 / (q1 + q2 + q3) AS q_home, q2 / (q1 + q2 + q3) AS q_draw, q3 / (q1 + q2 + q3) AS q_away,
         r1 / (r1 + r2 + r3) AS r_home, r2 / (r1 + r2 + r3) AS r_draw, r3 / (r1 + r2 + r3) AS r_away,
         0.5::DOUBLE + 0.3::DOUBLE * home_score + 0.2::DOUBLE * (k1 % 7) AS lam_h, 0.5::DOUBLE + 0.3::DOUBLE * away_score + 0.2::DOUBLE * (k2 % 7) AS lam_a
  FROM (SELECT *, CAST(1 + home_score + k1 % 5 AS DOUBLE) AS p1, CAST(1 + k3 % 4 AS DOUBLE) AS p2,
               CAST(1 + away_score + k2 % 5 AS DOUBLE) AS p3,
               CAST(2 + k1 % 9 AS DOUBLE) AS q1, CAST(1 + k2 % 3 AS DOUBLE) AS q2, CAST(2 + k3 % 9 AS DOUBLE) AS q3,
               CAST(1 + home_score AS DOUBLE) AS r1, CAST(1 + k3 % 2 AS DOUBLE) AS r2,
               CAST(1 + away_score AS DOUBLE) AS r3
        FROM games)""",
    "preds": """
  SELECT game_id, ts, league, y, 'm1' AS model, p_home AS p0, p_draw AS p1, p_away AS p2 FROM probs
  UNION ALL SELECT game_id, ts, league, y, 'm2', q_home, q_draw, q_away FROM probs
  UNION ALL SELECT game_id, ts, league, y, 'm3', r_home, r_draw, r_away FROM probs""",
    "ledger": """
  SELECT event_id, 'L' || CAST(user_id % 3 AS VARCHAR) AS league, 'user' AS entity_type, user_id AS entity_id,
         event_type AS source, ts - CAST((event_id % 5) * (event_id % 17) AS INT) * INTERVAL 1 MINUTE AS source_timestamp,
         ts + CAST(event_id % 7 AS INT) * INTERVAL 1 MINUTE AS retrieved_at,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS available_at,
         date_trunc('day', ts) + INTERVAL 1 DAY AS prediction_cutoff,
         CASE WHEN event_id % 19 = 0 THEN NULL ELSE sha256(props) END AS payload_hash,
         CASE WHEN event_id % 11 = 0 THEN 'UNAVAILABLE' WHEN event_id % 13 = 0 THEN 'UNVERIFIABLE' ELSE 'KNOWN' END
           AS status, value
  FROM events""",
    "plays": """
  SELECT game_id, play_order, inning, half, position, outs,
         CASE WHEN position = 0 AND l_suppkey % 4 <> 0 THEN 0 ELSE CAST(l_suppkey % 8 AS INT) END AS bases,
         balls, strikes, added_runs, pitcher_id, home, away, game_date, value, k1, k2,
         CAST(SUM(CASE WHEN half = 'B' THEN added_runs ELSE 0 END) OVER (PARTITION BY game_id)
              + CASE WHEN game_id % 10 = 0 THEN 1 ELSE 0 END AS INT) AS home_total,
         CAST(SUM(CASE WHEN half = 'T' THEN added_runs ELSE 0 END) OVER (PARTITION BY game_id) AS INT) AS away_total
  FROM (SELECT l_orderkey AS game_id, play_order, CAST((play_order + 3) // 4 AS INT) AS inning,
               CASE WHEN (play_order - 1) % 4 < 2 THEN 'T' ELSE 'B' END AS half,
               CAST((play_order - 1) % 2 AS INT) AS position,
               CASE WHEN (play_order - 1) % 2 = 0 THEN CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END
                    ELSE CAST(l_partkey % 3 AS INT) END AS outs,
               l_suppkey, CAST(l_partkey % 4 AS INT) AS balls, CAST(l_linenumber % 3 AS INT) AS strikes,
               CASE WHEN play_order = 1 AND l_orderkey % 5 <> 0 THEN 0 ELSE CAST(l_quantity AS INT) % 3 END AS added_runs,
               'P' || CAST(l_suppkey % 50 AS VARCHAR) AS pitcher_id, CAST(l_orderkey % 30 AS INT) AS home,
               CAST((l_orderkey * 7 + 3) % 30 AS INT) AS away, l_shipdate AS game_date, l_extendedprice AS value,
               l_partkey AS k1, l_suppkey AS k2
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                           l_shipdate, l_extendedprice) AS play_order FROM lineitem))""",
}

MODELS = {"m1": ("p_home", "p_draw", "p_away"), "m2": ("q_home", "q_draw", "q_away"), "m3": ("r_home", "r_draw", "r_away")}


_STAGED: dict[tuple[str, str], str] = {}


class Views:
    """Lazily built frames over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        """A driver table; zone-less timestamps become instants in the (UTC) session zone."""
        raw = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        casts = {f.name: F.col(f.name).cast("timestamp") for f in raw.schema if f.dataType.typeName() == "timestamp_ntz"}
        return raw.withColumns(casts) if casts else raw

    @cached_property
    def games(self) -> DataFrame:
        line = self.table("lineitem").filter(F.expr("l_suppkey % 30 <> l_partkey % 30"))
        return line.select(
            F.concat_ws(
                "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate"),
                F.round(F.col("l_extendedprice") * 100).cast("bigint"),
            ).alias("game_id"),
            F.col("l_shipdate").alias("ts"),
            F.col("l_returnflag").alias("league"),
            F.col("l_linestatus").alias("stage"),
            F.expr("int(l_suppkey % 30)").alias("home"),
            F.expr("int(l_partkey % 30)").alias("away"),
            F.expr("int(l_quantity) % 10").alias("home_score"),
            F.expr("int(round(l_discount * 100))").alias("away_score"),
            F.col("l_partkey").alias("k1"),
            F.col("l_suppkey").alias("k2"),
            F.col("l_orderkey").alias("k3"),
        )

    @cached_property
    def entity_rows(self) -> DataFrame:
        from tideline.operators.timeline import to_entity_rows

        return to_entity_rows(self.games)

    @cached_property
    def probs(self) -> DataFrame:
        d = lambda text: F.expr(text).cast("double")
        w = self.games.withColumns({
            "p1": d("1 + home_score + k1 % 5"), "p2": d("1 + k3 % 4"), "p3": d("1 + away_score + k2 % 5"),
            "q1": d("2 + k1 % 9"), "q2": d("1 + k2 % 3"), "q3": d("2 + k3 % 9"),
            "r1": d("1 + home_score"), "r2": d("1 + k3 % 2"), "r3": d("1 + away_score"),
        })
        shares = {}
        for a in "pqr":
            total = F.col(f"{a}1") + F.col(f"{a}2") + F.col(f"{a}3")
            for i, cls in enumerate(("home", "draw", "away"), 1):
                shares[f"{a}_{cls}"] = F.col(f"{a}{i}") / total
        return w.withColumns({
            "y": F.expr("CASE WHEN home_score > away_score THEN 0 WHEN home_score = away_score THEN 1 ELSE 2 END"),
            **shares,
            "lam_h": F.expr("0.5D + 0.3D * home_score + 0.2D * (k1 % 7)"),
            "lam_a": F.expr("0.5D + 0.3D * away_score + 0.2D * (k2 % 7)"),
        }).drop(*[f"{a}{i}" for a in "pqr" for i in (1, 2, 3)])

    @cached_property
    def preds(self) -> DataFrame:
        """Long form: one row per game and model, probabilities as p0/p1/p2."""
        members = F.array(*[
            F.struct(F.lit(m).alias("model"), F.col(c[0]).alias("p0"), F.col(c[1]).alias("p1"), F.col(c[2]).alias("p2"))
            for m, c in MODELS.items()
        ])
        return self.probs.select("game_id", "ts", "league", "y", F.inline(members))

    @cached_property
    def ledger(self) -> DataFrame:
        return self.ledger_of(self.table("events"))

    def stream(self, name: str) -> DataFrame:
        """A driver table as a file stream."""
        raw = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        casts = {f.name: F.col(f.name).cast("timestamp") for f in raw.schema if f.dataType.typeName() == "timestamp_ntz"}
        feed = self.spark.readStream.schema(raw.schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)
        return feed.withColumns(casts) if casts else feed

    @staticmethod
    def ledger_of(events: DataFrame) -> DataFrame:
        """The observation ledger of an event feed, batch or streaming."""
        return events.select(
            "event_id",
            F.expr("concat('L', user_id % 3)").alias("league"),
            F.lit("user").alias("entity_type"),
            F.col("user_id").alias("entity_id"),
            F.col("event_type").alias("source"),
            F.expr("ts - make_dt_interval(0, 0, int((event_id % 5) * (event_id % 17)), 0)").alias("source_timestamp"),
            F.expr("ts + make_dt_interval(0, 0, int(event_id % 7), 0)").alias("retrieved_at"),
            F.expr("CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END").alias("available_at"),
            F.expr("date_trunc('day', ts) + INTERVAL 1 DAY").alias("prediction_cutoff"),
            F.expr("CASE WHEN event_id % 19 = 0 THEN NULL ELSE sha2(props, 256) END").alias("payload_hash"),
            F.expr(
                "CASE WHEN event_id % 11 = 0 THEN 'UNAVAILABLE' WHEN event_id % 13 = 0 THEN 'UNVERIFIABLE' "
                "ELSE 'KNOWN' END"
            ).alias("status"),
            "value",
        )

    @cached_property
    def plays(self) -> DataFrame:
        """Play-by-play rows, staged once per session as a table in the shared folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _STAGED:
            path = scratch_path(self.spark, "plays")
            self._derive_plays().write.parquet(path)
            _STAGED[key] = path
        return self.spark.read.parquet(_STAGED[key])

    def _derive_plays(self) -> DataFrame:
        """Play-by-play rows: the lines of one order, in line order.

        Orders whose line numbers stay below 4,096 are numbered and summed in one shuffle; only the others go by stretches of 4,096."""
        line = self.table("lineitem").drop("l_tax", "l_returnflag", "l_linestatus", "l_discount")
        order, stretch = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], F.expr("l_linenumber div 4096")
        long = stored(line.filter(stretch.isNull() | (stretch != 0)).select("l_orderkey").filter("l_orderkey IS NOT NULL").distinct(), "long_orders")
        whole = Window.partitionBy("l_orderkey")
        runs = {"home_total": "sum(CASE WHEN half = 'B' THEN added_runs ELSE 0 END)", "away_total": "sum(CASE WHEN half = 'T' THEN added_runs ELSE 0 END)"}
        final = ["int(home_total + CASE WHEN game_id % 10 = 0 THEN 1 ELSE 0 END) AS home_total", "int(away_total) AS away_total"]
        short = line.join(long, "l_orderkey", "left_anti").withColumn("play_order", F.row_number().over(whole.orderBy(*order)).cast("bigint"))
        p = _play_rows(short)
        out = p.withColumns({n: F.expr(e).over(Window.partitionBy("game_id")) for n, e in runs.items()}).selectExpr(*p.columns, *final)
        numbered = row_numbers(line, ["l_orderkey"], order, seg=stretch, out="play_order")
        if not long.isEmpty():
            p = _play_rows(numbered.join(long, "l_orderkey", "left_semi"))
            totals = p.groupBy("game_id").agg(*[F.expr(e).alias(n) for n, e in runs.items()])
            out = out.unionByName(p.join(totals, "game_id").selectExpr(*p.columns, *final))
        return out


def _play_rows(numbered: DataFrame) -> DataFrame:
    return numbered.selectExpr(
        "l_orderkey AS game_id", "play_order", "int((play_order + 3) div 4) AS inning",
        "CASE WHEN (play_order - 1) % 4 < 2 THEN 'T' ELSE 'B' END AS half",
        "int((play_order - 1) % 2) AS position",
        "CASE WHEN (play_order - 1) % 2 = 0 THEN CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END "
        "ELSE int(l_partkey % 3) END AS outs",
        "CASE WHEN (play_order - 1) % 2 = 0 AND l_suppkey % 4 <> 0 THEN 0 ELSE int(l_suppkey % 8) END AS bases",
        "int(l_partkey % 4) AS balls", "int(l_linenumber % 3) AS strikes",
        "CASE WHEN play_order = 1 AND l_orderkey % 5 <> 0 THEN 0 ELSE int(l_quantity) % 3 END AS added_runs",
        "concat('P', l_suppkey % 50) AS pitcher_id", "int(l_orderkey % 30) AS home",
        "int((l_orderkey * 7 + 3) % 30) AS away", "l_shipdate AS game_date", "l_extendedprice AS value",
        "l_partkey AS k1", "l_suppkey AS k2",
    )

"""Queries over sources, sinks, set operations and scalar functions.

File round trips write under the shared checkpoint folder and read back what they wrote.
"""

from pyspark.sql import functions as F

from tideline.functions import arrays as A
from tideline.functions import scalars as C
from tideline.operators import playlog as L
from tideline.plans.catalog import register
from tideline.plans.q_timeline import us
from tideline.plans.views import Views
from tideline.session import scratch_path
from tideline.sources import layers as S

G = "game_id, league, home, away, home_score, away_score"
GCOLS = G.split(", ")
GDDL = "game_id string, league string, home int, away int, home_score int, away_score int"


@register("s1_read_layer", f"SELECT {G} FROM games")
def _(v: Views):
    root = scratch_path(v.spark, "layers")
    S.write_layer(v.games.filter("league = 'A'").select(*GCOLS), root, "curated", "games", "append")
    S.write_layer(v.games.filter("league <> 'A'").select(*GCOLS).withColumn("extra", F.lit(1)), root, "curated", "games", "append")
    return S.read_layer(v.spark, root, "curated", "games").select(*GCOLS)


@register("s2_write_layer_partitions", "SELECT game_id, CASE WHEN league = 'N' THEN home_score + 100 ELSE home_score END AS home_score, league FROM games")
def _(v: Views):
    root = scratch_path(v.spark, "layers")
    g = v.games.select("game_id", "home_score", "league")
    S.write_layer(g, root, "curated", "games", partition=["league"])
    S.write_layer(g.filter("league = 'N'").withColumn("home_score", F.col("home_score") + 100), root, "curated", "games", partition=["league"])
    return S.read_layer(v.spark, root, "curated", "games").select("game_id", "home_score", "league")


@register("s3_inventory", "SELECT 'lineitem' AS dataset, count(*) AS row_count, CAST(1 AS BIGINT) AS files FROM lineitem")
def _(v: Views):
    return S.inventory(v.table("lineitem"), "lineitem").select("dataset", "row_count", "files")


@register("s4_read_seasons", f"SELECT {G} FROM games")
def _(v: Views):
    root = scratch_path(v.spark, "seasons")
    v.games.select(*GCOLS).write.option("header", True).csv(f"{root}/season_files")
    v.games.filter("league = 'A'").select(*GCOLS).write.option("header", True).csv(f"{root}/legacy")
    return S.read_seasons(v.spark, [f"{root}/aggregate", f"{root}/season_files", f"{root}/legacy"], "game_id", GDDL)


@register("s5_read_player_games", "SELECT CAST(k3 AS VARCHAR) AS game_id, CAST(k1 AS VARCHAR) AS player_id, CASE WHEN k1 % 3 = 0 THEN 'unknown' ELSE 'H' END AS side, home_score AS h FROM games WHERE k1 % 11 > 0")
def _(v: Views):
    path = scratch_path(v.spark, "players")
    v.games.select(F.col("k3").alias("game_id"), F.expr("CASE WHEN k1 % 11 > 0 THEN concat(' ', k1, ' ') END").alias("player_id"), F.expr("CASE WHEN k1 % 3 > 0 THEN 'H' END").alias("side"), F.col("home_score").alias("h")).write.option("header", True).csv(path)
    return S.read_player_games(v.spark, path, "game_id string, player_id string, side string, h int")


@register("s6_read_pbp", "SELECT CAST(game_id AS VARCHAR) AS game_id, CAST(count(*) AS BIGINT) AS n, CAST(SUM(added_runs) AS DOUBLE) AS runs FROM plays GROUP BY 1")
def _(v: Views):
    root = scratch_path(v.spark, "pbp")
    raw = v.plays.select("game_id", F.col("inning"), F.col("half").alias("TB"), F.col("play_order").alias("play_id"), F.col("outs").alias("out"), F.col("home").alias("H_NameS"), F.col("away").alias("V_NameS"),
                         F.col("home_total").alias("H_R"), F.col("away_total").alias("V_R"), F.col("added_runs").alias("addedRuns"))
    raw.write.option("header", True).csv(f"{root}/season_pbp.csv")
    files = v.spark.read.schema(raw.schema).option("header", True).csv(f"{root}/*_pbp.csv")
    out = L.canonicalize_plays(files)
    return out.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.sum("added_runs").alias("runs"))


LDDL = "event_id bigint, league string, entity_type string, entity_id bigint, source string, source_timestamp timestamp, retrieved_at timestamp, available_at timestamp, payload_hash string, status string, value double"


@register("s7_read_ledger", "SELECT event_id, source, CAST(epoch_us(retrieved_at) AS BIGINT) AS retrieved_us, status, value FROM ledger")
def _(v: Views):
    path = scratch_path(v.spark, "ledger")
    S.append_ledger(v.ledger.filter("event_id % 2 = 0").drop("prediction_cutoff"), path)
    S.append_ledger(v.ledger.filter("event_id % 2 = 1").drop("prediction_cutoff"), path)
    return S.read_ledger(v.spark, path, LDDL).select("event_id", "source", F.unix_micros("retrieved_at").alias("retrieved_us"), "status", "value")


@register("s8_append_ledger", """SELECT event_id, source, status, value FROM ledger
WHERE retrieved_at IS NOT NULL AND COALESCE(source_timestamp <= retrieved_at, TRUE) AND COALESCE(available_at <= retrieved_at, TRUE)""")
def _(v: Views):
    # two appends of validated rows; the second leaves what the first wrote untouched
    path = scratch_path(v.spark, "ledger")
    led = v.ledger.drop("prediction_cutoff")
    ok = F.col("retrieved_at").isNotNull() & F.coalesce(F.col("source_timestamp") <= F.col("retrieved_at"), F.lit(True)) & F.coalesce(F.col("available_at") <= F.col("retrieved_at"), F.lit(True))
    for part in (0, 1):
        S.append_ledger(led.filter(ok & (F.col("event_id") % 2 == part)), path)
    return S.read_ledger(v.spark, path, LDDL).select("event_id", "source", "status", "value")


@register("s9_append_once", "SELECT event_id, value FROM ledger")
def _(v: Views):
    path = scratch_path(v.spark, "once")
    led = v.ledger.select("event_id", "value", F.sha2(F.col("value").cast("string"), 256).alias("content"))
    S.append_once(led.filter("event_id % 3 > 0"), path, "event_id", "content")
    S.append_once(led.filter("event_id % 3 < 2"), path, "event_id", "content")
    return v.spark.read.parquet(path).select("event_id", "value")


@register("s10_incremental_upsert", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS value FROM events")
def _(v: Views):
    e = v.table("events").select("event_id", "value")
    return S.incremental_upsert(e.filter("event_id % 10 <> 5"), e.filter("event_id % 5 = 0").withColumn("value", F.col("value") + 1), ["event_id"])


@register("s11_normalize_schedule", "SELECT game_id, home, away, home_score FROM games WHERE k1 % 3 = 2 AND k2 % 7 > 0")
def _(v: Views):
    raw = v.games.select(F.col("game_id").alias("GameID"), F.col("home").alias("HomeTeam"), F.col("away").alias("VisitorTeam"), F.expr("CASE WHEN k2 % 7 > 0 THEN home_score END").alias(" HomeScore"), F.expr("k1 % 3").alias("GameState"))
    return S.normalize_schedule(raw, {"game_id": ["gameid", "id"], "home": ["home", "hometeam"], "away": ["visitorteam"], "home_score": ["homescore"]}, "gamestate", 2, ["game_id", "home", "home_score"])


@register("s12_read_baseline_games", "SELECT game_id, league AS sport, CASE WHEN league = 'A' THEN home_score END AS home_runs, CASE WHEN league <> 'A' THEN home_score END AS home_goals FROM games")
def _(v: Views):
    root = scratch_path(v.spark, "sports")
    parts = []
    for sport in ("A", "N", "R"):
        col = "home_runs" if sport == "A" else "home_goals"
        v.games.filter(F.col("league") == sport).select("game_id", F.col("home_score").alias(col)).write.parquet(f"{root}/{sport}")
        parts.append(v.spark.read.parquet(f"{root}/{sport}").withColumn("sport", F.lit(sport)))
    return S.union_all(parts).select("game_id", "sport", "home_runs", "home_goals")


@register("s13_games_from_schedule_json", "SELECT game_id, CAST(epoch_us(ts) AS BIGINT) AS ts_us, CAST(home AS VARCHAR) AS home, CAST(away AS VARCHAR) AS away, home_score, away_score, 'P' || k1 AS home_starter FROM games WHERE k2 % 4 > 0")
def _(v: Views):
    path = scratch_path(v.spark, "schedule")
    # one document per game and date keeps documents small however many games a day has
    doc = F.expr("""named_struct('dates', array(named_struct('date', date_format(ts, 'yyyy-MM-dd'), 'games', array(named_struct('gamePk', game_id, 'status', CASE WHEN k2 % 4 > 0 THEN 'Final' ELSE 'Scheduled' END,
      'gameDate', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), 'teams', named_struct('home', named_struct('name', string(home), 'score', home_score, 'starter', concat('P', k1)), 'away', named_struct('name', string(away), 'score', away_score, 'starter', concat('P', k2))))))))""")
    v.games.select(F.to_json(doc).alias("value")).write.text(path)
    out = S.games_from_schedule_json(v.spark.read.schema(S.SCHEDULE).json(path))
    return us(out)


@register("s14_pitch_union_dedup", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem GROUP BY ALL")
def _(v: Views):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    t = v.table("lineitem").select(*keys)
    return S.union_all([t.filter("l_linenumber <= 4"), t.filter("l_linenumber >= 3")]).dropDuplicates(keys)


@register("s15_stage_artifact", "SELECT (SELECT count(*) FROM lineitem) AS rows_pitch, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS rows_games, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS rows_lagged, 'UNVERIFIED' AS tracking_pit_status, FALSE AS historical_backtest_eligible, FALSE AS production_eligible")
def _(v: Views):
    t = v.table("lineitem")
    games = t.groupBy("l_orderkey").agg(F.avg("l_quantity").alias("q"))
    return S.stage_artifact(t, games, games.withColumn("q", F.lit(0.0)), scratch_path(v.spark, "artifact"))


@register("s16_observation_records", """WITH s AS (SELECT DISTINCT k3, k1 FROM games), g AS (SELECT k3, MIN(game_id) AS gid FROM games WHERE k3 % 3 > 0 GROUP BY 1)
SELECT s.k3, s.k1, COALESCE(gid, substr(sha256(CAST(s.k3 AS VARCHAR)), 1, 24)) AS event_id, CASE WHEN gid IS NULL THEN 'HASH' ELSE 'SCHEDULE' END AS id_source FROM s LEFT JOIN g USING (k3)""")
def _(v: Views):
    sched = v.games.filter("k3 % 3 > 0").groupBy("k3").agg(F.min("game_id").alias("event_id"))
    return S.observation_records(v.games.select("k3", "k1").distinct(), sched, ["k3"])


@register("u1_union_drift", "SELECT o_orderkey AS id, o_totalprice AS price, NULL AS size FROM orders UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def _(v: Views):
    return S.union_all([v.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))])


@register("u2_keep_latest", "SELECT entity_id, source, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, source ORDER BY retrieved_at DESC, event_id DESC) AS rk FROM ledger) WHERE rk = 1")
def _(v: Views):
    return S.keep_latest(v.ledger.select("entity_id", "source", "event_id", "value", "retrieved_at"), ["entity_id", "source"], ["retrieved_at", "event_id"]).drop("retrieved_at")


@register("u3_keep_first", "SELECT entity_id, source, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, source ORDER BY retrieved_at, event_id) AS rk FROM ledger) WHERE rk = 1")
def _(v: Views):
    return S.keep_first(v.ledger.select("entity_id", "source", "event_id", "value", "retrieved_at"), ["entity_id", "source"], ["retrieved_at", "event_id"]).drop("retrieved_at")


@register("u4_set_report", """SELECT o_orderkey AS id, 'missing' AS issue FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <> 3) UNION ALL SELECT id, 'unexpected' FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber <> 3) WHERE id NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT l_orderkey, 'duplicate' FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1 HAVING count(*) > 1""")
def _(v: Views):
    return S.set_report(v.table("orders").select(F.col("o_orderkey").alias("id")), v.table("lineitem").filter("l_linenumber <> 3").select(F.col("l_orderkey").alias("id")), "id")


@register("u5_replace_by_key", "SELECT game_id, CAST(year(ts) AS INT) AS season, home_score + CASE WHEN year(ts) = 1998 THEN 50 ELSE 0 END AS home_score FROM games WHERE year(ts) <> 1998 OR k1 % 2 = 0")
def _(v: Views):
    g = v.games.select("game_id", F.year("ts").alias("season"), "home_score", "k1")
    fresh = g.filter("season = 1998 AND k1 % 2 = 0").withColumn("home_score", F.col("home_score") + 50)
    return S.replace_by_key(g, fresh, "season").drop("k1")


@register("u6_equality_gate", "SELECT CAST(SUM(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right FROM lineitem")
def _(v: Views):
    t = v.table("lineitem")
    return S.equality_gate(t, t.filter("l_linenumber < 7"))


@register("f_string_functions", """SELECT event_id, upper(trim(event_type)) AS up, regexp_extract(props, '([0-9]+)', 1) AS digits, replace(event_type, 'i', '_') AS repl, event_type LIKE '%ic%' AS has_ic, split_part(event_type || '-x', '-', 2) AS part2, lpad(CAST(event_id AS VARCHAR), 8, '0') AS padded FROM events""")
def _(v: Views):
    return v.table("events").select("event_id", F.upper(F.trim("event_type")).alias("up"), F.regexp_extract("props", "([0-9]+)", 1).alias("digits"), F.regexp_replace("event_type", "i", "_").alias("repl"),
                                    F.contains("event_type", F.lit("ic")).alias("has_ic"), F.split_part(F.concat("event_type", F.lit("-x")), F.lit("-"), F.lit(2)).alias("part2"), F.lpad(F.col("event_id").cast("string"), 8, "0").alias("padded"))


@register("f_starter_extraction", "SELECT event_id, 'P' || user_id AS home_starter, 'Q' || event_id % 9 AS away_starter FROM events")
def _(v: Views):
    text = F.expr("concat('先発ピッチャーはホームがP', user_id, '、ビジターがQ', event_id % 9, '、です')")
    found = v.table("events").select("event_id", F.regexp_extract_all(text, F.lit("(?:は|、)(?:ホーム|ビジター)が([^、]+)"), F.lit(1)).alias("x"))
    return found.select("event_id", F.col("x")[0].alias("home_starter"), F.col("x")[1].alias("away_starter"))


@register("f_time_functions", """SELECT event_id, CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS hour_us, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS local_day, strftime(ts, '%Y-%m') AS month, CAST(year(ts) AS INT) AS season, ROUND((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 60e6, 8) AS minutes FROM events""")
def _(v: Views):
    return us(v.table("events").select("event_id", F.unix_micros(F.date_trunc("hour", "ts")).alias("hour_us"), C.local_date(F.col("ts"), "Asia/Tokyo").cast("string").alias("local_day"), F.date_format("ts", "yyyy-MM").alias("month"),
                                       F.year("ts").alias("season"), C.minutes_between(F.col("ts"), F.date_trunc("day", "ts")).alias("minutes")), digits=8)


@register("f_strict_timestamp", "SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) - 32400000000 ELSE 0 END AS BIGINT) AS us FROM events")
def _(v: Views):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(F.expr("event_id % 3 = 0"), F.concat(iso, F.lit("Z"))).when(F.expr("event_id % 3 = 1"), F.concat(iso, F.lit("+09:00"))).otherwise(iso)
    return v.table("events").select("event_id", F.coalesce(F.unix_micros(C.strict_timestamp(text)), F.lit(0)).alias("us"))


@register("f_distances", """WITH d AS (SELECT game_id, abs(p_home - q_home) + abs(p_draw - q_draw) + abs(p_away - q_away) AS l1, sqrt(pow(p_home - q_home, 2) + pow(p_draw - q_draw, 2) + pow(p_away - q_away, 2)) AS l2, p_home * ln(p_home / q_home) + p_draw * ln(p_draw / q_draw) + p_away * ln(p_away / q_away) AS kl,
 (p_home * q_home + p_draw * q_draw + p_away * q_away) / (sqrt(p_home * p_home + p_draw * p_draw + p_away * p_away) * sqrt(q_home * q_home + q_draw * q_draw + q_away * q_away)) AS cosine, -(p_home * ln(p_home) + p_draw * ln(p_draw) + p_away * ln(p_away)) AS h FROM probs)
SELECT game_id, ROUND(l1, 8) AS l1, ROUND(l2, 8) AS l2, ROUND(l1 / 2, 8) AS tv, ROUND(kl, 8) + 0.0 AS kl, ROUND(cosine, 8) AS cosine, ROUND(h, 8) AS entropy FROM d""")
def _(v: Views):
    p, q = A.vec("p_home", "p_draw", "p_away"), A.vec("q_home", "q_draw", "q_away")
    return us(v.probs.select("game_id", A.l1(p, q).alias("l1"), A.l2(p, q).alias("l2"), A.total_variation(p, q).alias("tv"), A.kl(p, q).alias("kl"), A.cosine(p, q).alias("cosine"), A.entropy(p).alias("entropy")), digits=8)


@register("f_array_functions", "SELECT vec_id, len(embedding) AS n, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS top, ROUND(list_sum(list_transform(embedding[-5:], lambda x: CAST(x AS DOUBLE))), 6) AS tail_sum FROM embeddings")
def _(v: Views):
    e = F.col("embedding")
    tail = F.transform(A.tail(e, 5), lambda x: x.cast("double"))
    return us(v.table("embeddings").select("vec_id", F.size(e).cast("bigint").alias("n"), A.arg_max(e).alias("top"), A.asum(tail).alias("tail_sum")), digits=6)


@register("f_json_functions", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS VARCHAR) AS found FROM events")
def _(v: Views):
    deep = F.concat(F.lit('{"a":[{"b":'), F.col("props"), F.lit("}]}"))
    return v.table("events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"), S.find_values(deep, ["k"])[0].alias("found"))


@register("f_hash_functions", "SELECT event_id, substr(sha256(CAST(event_id AS VARCHAR) || '|' || event_type), 1, 24) AS id, sha256(props) AS digest FROM events")
def _(v: Views):
    return v.table("events").select("event_id", C.short_hash(F.col("event_id").cast("string"), F.col("event_type")).alias("id"), F.sha2("props", 256).alias("digest"))


@register("f_host_allowed", r"SELECT page_id, regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) LIKE '%.example.com' OR regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) = 'thther.example.org' AS official FROM pages")
def _(v: Views):
    return v.table("pages").select("page_id", C.host_allowed(F.col("url"), ["thther.example.org"], [".example.com"]).alias("official"))

"""Play-by-play operators: canonical rows, running state, transitions, half-inning sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import arrays as A
from tideline.functions.scalars import clean_text, ratio, safe_double
from tideline.operators import ordered as O
from tideline.session import materialize

# Accepted spellings of the half and the limits of a legal state.
TOP_WORDS, BOTTOM_WORDS = ("T", "TOP", "表"), ("B", "BOT", "BOTTOM", "裏")
MAX_INNING, MAX_OUTS, MAX_RUNS, MAX_DIFF = 12, 2, 4, 8


def first_existing(df: DataFrame, names: Sequence[str], default: object = None) -> Column:
    """The first of the named columns that exists, chosen when the plan is built."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(default)


def half_code(c: Column) -> Column:
    word = F.upper(F.trim(c.cast("string")))
    return F.when(word.isin(*TOP_WORDS), "T").when(word.isin(*BOTTOM_WORDS), "B").otherwise("")


def occupied(c: Column) -> Column:
    """A base counts as occupied unless the value is blank, a missing word, false, or zero."""
    text = F.lower(clean_text(c))
    empty = text.isin("", "0", "0.0", "false") | (F.coalesce(text.try_cast("double"), F.lit(1.0)) == 0.0)
    return ~empty


def base_mask(b1: Column, b2: Column, b3: Column) -> Column:
    return occupied(b1).cast("int") + F.shiftleft(occupied(b2).cast("int"), 1) + F.shiftleft(occupied(b3).cast("int"), 2)


def canonicalize_plays(raw: DataFrame) -> DataFrame:
    """Resolve column aliases, keep valid states only, and keep the last row per play identity."""
    num = lambda *names: safe_double(first_existing(raw, names))
    text = lambda *names: clean_text(first_existing(raw, names, ""))
    out = raw.select(
        text("game_id", "GameID").alias("game_id"), num("inning", "Inning").alias("inning"),
        half_code(first_existing(raw, ("TB", "half", "Half"), "")).alias("half"),
        num("PlayInfo_SeqNo", "play_id", "ID", "page").alias("play_order"),
        num("pitch_number", "atBatBallCount").alias("pitch_number"),
        text("page", "fiveDigitSerialNumber").alias("page"),
        text("home_team_name", "H_NameS").alias("home"), text("away_team_name", "V_NameS").alias("away"),
        num("home_total_runs", "H_R").alias("home_score"), num("away_total_runs", "V_R").alias("away_score"),
        num("addedRuns", "added_runs").alias("added_runs"), num("outs_when_up", "out").alias("outs"),
        num("balls", "ball").alias("balls"), num("strikes", "strike").alias("strikes"),
        base_mask(*[first_existing(raw, (f"on_{i}b", f"base{i}")) for i in (1, 2, 3)]).alias("bases"),
    )
    out = out.withColumns({c: F.rint(c).cast("int") for c in ("inning", "outs")})
    valid = (
        (F.col("game_id") != "") & (F.col("home") != "") & (F.col("away") != "") & F.col("half").isin("T", "B")
        & F.col("inning").between(1, MAX_INNING) & F.col("outs").between(0, MAX_OUTS) & F.col("play_order").isNotNull()
        & (F.col("home_score") >= 0) & (F.col("away_score") >= 0)
    )
    identity = F.when(F.col("page") != "", F.concat_ws("|", "game_id", "page")).otherwise(
        F.concat_ws("|", "game_id", "inning", "half", "play_order"))
    kept = out.filter(valid).withColumn("_identity", identity)
    order = ["inning", F.when(F.col("half") == "T", 0).otherwise(1), "play_order", F.coalesce("pitch_number", F.lit(-1.0))]
    return O.latest_by(kept, ["game_id", "_identity"], order).drop("_identity")


def place(order: Sequence[str]) -> Column:
    """What min_by and max_by go by: the column itself where there is one, so that plain values are aggregated by hash and never sorted first."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def state_scores(plays: DataFrame, order: Sequence[str], seg: Column) -> DataFrame:
    """Running score after each play; games whose increments or final score do not reconcile are left out whole."""
    runs = F.col("added_runs").cast("double")
    bad = runs.isNull() | (runs < 0) | (runs > MAX_RUNS) | (F.abs(runs - F.rint(runs)) > 1e-9)
    per_game = plays.groupBy("game_id").agg(
        F.max(bad.cast("int")).alias("_bad"),
        F.sum(F.when(F.col("half") == "B", runs).otherwise(0.0)).alias("_h"),
        F.sum(F.when(F.col("half") == "T", runs).otherwise(0.0)).alias("_a"),
        F.min_by(runs, place(order)).alias("_first"),
        *[F.max_by(F.rint(f"{side}_total"), place(order)).alias(f"_last_{side}") for side in ("home", "away")],
    )
    ok = per_game.filter(
        (F.col("_bad") == 0) & (F.col("_first") == 0) & (F.col("_h") == F.col("_last_home")) & (F.col("_a") == F.col("_last_away"))
    ).select("game_id")
    kept = plays.join(ok, "game_id", "left_semi")
    sums = {"state_home": F.when(F.col("half") == "B", F.col("added_runs")).otherwise(0),
            "state_away": F.when(F.col("half") == "T", F.col("added_runs")).otherwise(0)}
    return O.running_sums(kept, ["game_id"], order, sums, seg=seg)


def inning_band(inning: Column) -> Column:
    return F.when(inning <= 3, 1).when(inning <= 6, 2).when(inning <= 9, 3).otherwise(4)


def score_diff(df_home: Column, df_away: Column) -> Column:
    return F.greatest(F.lit(-MAX_DIFF), F.least(F.lit(MAX_DIFF), F.rint(df_home - df_away).cast("int")))


def _numbered(df: DataFrame, order: Sequence[str], seg: Column, dense: str | None) -> DataFrame:
    """Row numbers per game, taken from ``dense`` when that column already counts 1, 2, 3, ... within a game."""
    return df.withColumn("rn", F.col(dense)) if dense else O.row_numbers(df, ["game_id"], order, seg)


def transitions(states: DataFrame, order: Sequence[str], seg: Column, dense: str | None = None) -> DataFrame:
    """Legal row -> next row moves with the state key columns of the source row and one outcome label."""
    nxt = F.struct("inning", "half", "outs", "bases", "balls", "strikes", "state_home", "state_away")
    spread, w = O.blocks(_numbered(states, order, seg, dense), ["game_id"], back=0, ahead=1)
    pair = O.drop_halo(spread.withColumn("n", F.lead(nxt).over(w))).filter(F.col("n").isNotNull())
    same = (F.col("inning") == F.col("n.inning")) & (F.col("half") == F.col("n.half"))
    down = (F.col("inning") == F.col("n.inning")) & (F.col("half") == "T") & (F.col("n.half") == "B")
    up = (F.col("half") == "B") & (F.col("n.half") == "T") & (F.col("n.inning") == F.col("inning") + 1)
    outs = F.col("n.outs") - F.col("outs")
    shape = F.when(same, outs.between(0, 2)).when(down | up, (F.col("n.outs") == 0) & (F.col("n.bases") == 0)).otherwise(False)
    dh, da = F.col("n.state_home") - F.col("state_home"), F.col("n.state_away") - F.col("state_away")
    score = dh.between(0, MAX_RUNS) & da.between(0, MAX_RUNS) & ~((dh > 0) & (da > 0))
    scorer = F.when(dh > 0, "H").when(da > 0, "A").otherwise("N")
    outcome = F.concat_ws("|", "n.half", "n.outs", "n.bases", "n.balls", "n.strikes", (dh + da).cast("int"), scorer)
    return pair.filter(shape & score).select(
        "game_id", inning_band(F.col("inning")).alias("band"), "half", "outs", "bases",
        score_diff(F.col("state_home"), F.col("state_away")).alias("diff"), "balls", "strikes", outcome.alias("outcome"))


VIEWS = {
    "rich": ("band", "half", "outs", "bases", "diff", "balls", "strikes"),
    "no_count": ("band", "half", "outs", "bases", "diff"),
    "no_diff": ("band", "half", "outs", "bases", "balls", "strikes"),
    "coarse": ("band", "half", "outs", "bases"),
    "half": ("half",),
    "global": (),
}
STATE = VIEWS["rich"]


def transition_counts(moves: DataFrame) -> DataFrame:
    """Counts of outcome per state at six grains in one pass; the grain comes from ``grouping_id``, not from NULLs."""
    sets = [[F.col(c) for c in (*cols, "outcome")] for cols in VIEWS.values()]
    names = {sum(1 << (len(STATE) - i) for i, c in enumerate(STATE) if c not in cols): v for v, cols in VIEWS.items()}
    grouped = moves.groupingSets(sets, *STATE, "outcome").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    view = F.lit(None).cast("string")
    for g, v in names.items():
        view = F.when(F.col("_g") == g, v).otherwise(view)
    return grouped.select(view.alias("view"), *STATE, "outcome", "n")


def kernel_probability(states: DataFrame, counts: DataFrame, min_support: int = 24, alpha: float = 0.5) -> DataFrame:
    """Back-off view per state: the first grain with enough support, else the first non-empty; smoothed entropy.

    ``(n+alpha)/(N+alpha*K)``; the entropy comes from per-state sums, so no outcome list is ever joined.
    """
    keyed = F.concat_ws("|", F.col("view"), *[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in STATE])
    smooth = F.col("n") + alpha
    # -sum(t*log t) with t = (n+alpha)/D equals log D - sum((n+alpha)*log(n+alpha))/D: one aggregate, no self join
    per_key = counts.groupBy(keyed.alias("_key")).agg(
        F.sum("n").alias("support"), F.count(F.lit(1)).alias("outcomes"), F.sum(smooth * F.log(smooth)).alias("_nlogn"))
    total = F.col("support") + alpha * F.col("outcomes")
    per_key = per_key.withColumn("entropy", F.log(total) - F.col("_nlogn") / total).drop("_nlogn")
    keys = [
        F.struct(F.lit(i).alias("rank"), F.lit(v).alias("view"),
                 F.concat_ws("|", F.lit(v), *[F.col(c).cast("string") if c in cols else F.lit("*") for c in STATE]).alias("_key"))
        for i, (v, cols) in enumerate(VIEWS.items())
    ]
    tried = states.select(*states.columns, F.inline(F.array(*keys))).join(per_key, "_key")
    best = F.struct(F.when(F.col("support") >= min_support, 0).otherwise(1), "rank")
    picked = tried.groupBy(*states.columns).agg(F.min_by(F.struct("view", "support", "outcomes", "entropy"), best).alias("_pick"))
    return picked.select(*states.columns, "_pick.*")


def half_innings(plays: DataFrame, order: Sequence[str], seg: Column, home: str = "state_home", away: str = "state_away",
                 dense: str | None = None) -> DataFrame:
    """Gaps and islands: one row per run of plays with the same (inning, half), with its score before and after.

    Rows without an inning or half are skipped before islands are formed; a falling score fails the query.
    """
    known = plays.filter(F.col("inning").isNotNull() & F.col("half").isin("T", "B"))
    spread, w = O.blocks(_numbered(known, order, seg, dense), ["game_id"])
    changed = F.coalesce((F.lag("inning").over(w) != F.col("inning")) | (F.lag("half").over(w) != F.col("half")), F.lit(True))
    flagged = O.drop_halo(spread.withColumn("_new", changed.cast("int")))
    islands = O.running_sums(flagged, ["game_id"], ["rn"], {"island": F.col("_new")}, seg=F.floor((F.col("rn") - 1) / O.BLOCK))
    rows = islands.groupBy("game_id", "island").agg(
        F.min("inning").alias("inning"), F.min("half").alias("half"), F.count(F.lit(1)).alias("plays"),
        F.max_by(F.struct(F.col(home).alias("h"), F.col(away).alias("a")), "rn").alias("_end"))
    spread, w = O.blocks(rows, ["game_id"], rn="island")
    before = F.lag("_end").over(w)
    out = O.drop_halo(spread.withColumn("_start", before)).select(
        "game_id", "island", "inning", "half", "plays",
        F.coalesce("_start.h", F.lit(0)).alias("start_home"), F.coalesce("_start.a", F.lit(0)).alias("start_away"),
        F.col("_end.h").alias("end_home"), F.col("_end.a").alias("end_away"))
    dh, da = F.col("end_home") - F.col("start_home"), F.col("end_away") - F.col("start_away")
    runs = F.when(F.col("half") == "T", da).otherwise(dh)
    checked = F.when((dh < 0) | (da < 0), F.raise_error(F.lit("score fell within a game")).cast("bigint")).otherwise(runs)
    diff = F.when(F.col("half") == "T", F.col("start_away") - F.col("start_home")).otherwise(F.col("start_home") - F.col("start_away"))
    return out.withColumns({"runs": checked, "score_diff_for": diff})


def game_table(halves: DataFrame) -> DataFrame:
    """Final score and class of each game from its last half-inning."""
    last = O.latest_by(halves.select("game_id", "inning", "half", "end_home", "end_away"), ["game_id"],
                       ["inning", F.when(F.col("half") == "T", 0).otherwise(1)])
    h, a = F.col("end_home"), F.col("end_away")
    return last.select("game_id", h.alias("actual_home"), a.alias("actual_away"),
                       F.when(h > a, 0).when(h == a, 1).otherwise(2).alias("actual_class"))


RATE_VIEWS = {"inning_half": ("inning", "half"), "offense": ("offense",), "defense": ("defense",), "score_state": ("bucket",), "league": ()}


def shrunk_run_rates(halves: DataFrame, prior: float = 12.0) -> DataFrame:
    """Mean runs by inning-half, offence, defence and score bucket, shrunk to the overall mean, in one pass."""
    tagged = halves.withColumn("bucket", F.greatest(F.lit(-3), F.least(F.lit(3), F.rint("score_diff_for").cast("int"))))
    cols = ("inning", "half", "offense", "defense", "bucket")
    sets = [[F.col(c) for c in v] for v in RATE_VIEWS.values()]
    g = tagged.groupingSets(sets, *cols).agg(F.sum("runs").alias("_runs"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    names = {sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in v): k for k, v in RATE_VIEWS.items()}
    view = F.lit(None).cast("string")
    for code, k in names.items():
        view = F.when(F.col("_g") == code, k).otherwise(view)
    keyed = g.select(view.alias("view"), F.concat_ws(":", *[F.col(c).cast("string") for c in cols]).alias("key"), "_runs", "n")
    mean = keyed.filter("view = 'league'").select((F.col("_runs") / F.col("n")).alias("_mean"), F.lit(1).alias("_one"))
    # one-row table joined on a constant key: the overall mean
    out = keyed.withColumn("_one", F.lit(1)).join(mean, "_one")
    rate = F.when(F.col("view") == "league", F.col("_mean")).otherwise((F.col("_runs") + prior * F.col("_mean")) / (F.col("n") + prior))
    return out.select("view", "key", "n", rate.alias("rate"))


def half_rate(df: DataFrame, rates: DataFrame) -> DataFrame:
    """Expected runs of a half: base times tempered offence, defence and score-state ratios, within 0.03..4."""
    rates = materialize(rates)  # a handful of rows per view, read five times below
    out = df.withColumn("_one", F.lit(1)).join(
        rates.filter("view = 'league'").select(F.col("rate").alias("_league"), F.lit(1).alias("_one")), "_one").drop("_one")
    keys = {
        "inning_half": F.concat_ws(":", F.col("inning").cast("string"), "half"), "offense": F.col("offense").cast("string"),
        "defense": F.col("defense").cast("string"),
        "score_state": F.greatest(F.lit(-3), F.least(F.lit(3), F.rint("score_diff_for").cast("int"))).cast("string"),
    }
    for v, key in keys.items():
        out = out.withColumn("_k", key).join(rates.filter(F.col("view") == v).select(F.col("key").alias("_k"), F.col("rate").alias(f"_{v}")), "_k", "left").drop("_k")
    mean = F.greatest("_league", F.lit(0.03))
    part = lambda v: F.log(F.greatest(F.coalesce(F.col(f"_{v}"), mean), F.lit(0.03)) / mean)
    base = F.greatest(F.coalesce("_inning_half", "_league"), F.lit(0.03))
    rate = base * F.exp(0.60 * part("offense") + 0.55 * part("defense") + 0.20 * part("score_state"))
    return out.withColumn("half_rate", A.clip(rate, 0.03, 4.0)).drop("_league", *[f"_{v}" for v in keys])


def aggregate_games(plays: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per game: first teams and date, last known score, relief appearances per side (distinct pitchers minus one)."""
    pos = place(order)
    known = lambda c: F.when(F.col(c).isNotNull(), pos)
    # distinct pitchers are pre-aggregated, so a long game never meets in one task
    apps = plays.filter(clean_text(F.col("pitcher_id")) != "").groupBy("game_id", "half", "pitcher_id").agg(F.count(F.lit(1)).alias("_x"))
    apps = apps.groupBy("game_id").agg(
        F.greatest(F.lit(0), F.sum((F.col("half") == "B").cast("int")) - 1).alias("home_bullpen_apps"),
        F.greatest(F.lit(0), F.sum((F.col("half") == "T").cast("int")) - 1).alias("away_bullpen_apps"))
    base = plays.groupBy("game_id").agg(
        F.min_by("home", pos).alias("home"), F.min_by("away", pos).alias("away"), F.min_by("game_date", pos).alias("game_date"),
        F.max_by("home_total", known("home_total")).alias("home_score"), F.max_by("away_total", known("away_total")).alias("away_score"))
    return base.join(apps, "game_id", "left")


def reconstruct_score(plays: DataFrame) -> DataFrame:
    """Score from positive play increments by half."""
    runs = F.greatest(F.lit(0), F.col("added_runs"))
    return plays.groupBy("game_id").agg(
        F.sum(F.when(F.col("half") == "B", runs).otherwise(0)).alias("home_score"),
        F.sum(F.when(F.col("half") == "T", runs).otherwise(0)).alias("away_score"))


def score_from_text(events: DataFrame, text: str, half: str) -> DataFrame:
    """Fallback: the largest run count named in the event texts of each half."""
    runs = F.regexp_extract(text, r"(?i)(?:runs?|得点)[=: ]+(\d+)", 1).try_cast("double")
    return events.groupBy("game_id").agg(
        F.coalesce(F.max(F.when(F.col(half) == "B", runs)), F.lit(0.0)).alias("home_score"),
        F.coalesce(F.max(F.when(F.col(half) == "T", runs)), F.lit(0.0)).alias("away_score"))


def first_pitchers(plays: DataFrame, order: Sequence[str]) -> DataFrame:
    """Earliest pitcher of each half: the home side pitches in the top."""
    known = plays.filter(clean_text(F.col("pitcher_id")) != "")
    pos = F.struct(*order)
    return known.groupBy("game_id").agg(
        F.min_by(F.when(F.col("half") == "T", F.col("pitcher_id")), F.when(F.col("half") == "T", pos)).alias("home_first"),
        F.min_by(F.when(F.col("half") == "B", F.col("pitcher_id")), F.when(F.col("half") == "B", pos)).alias("away_first"))


def coverage_counts(plays: DataFrame, conditions: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Rows and how many of them carry each kind of information."""
    return plays.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in conditions.items()])


def pitch_game_features(pitches: DataFrame, keys: Sequence[str] = ("game_id", "side")) -> DataFrame:
    """Per game and side: mean velocity, spin, breaks, exit velocity, angle, distance, hard-hit and barrel shares; 0 when empty."""
    means = {"release_speed": "velocity", "release_spin": "spin", "pfx_x": "h_break", "pfx_z": "v_break",
             "launch_speed": "exit_velocity", "launch_angle": "launch_angle", "hit_distance": "hit_distance"}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = lambda col, cond: zero(ratio(F.sum(F.when(cond, 1).otherwise(0)), F.count(col)))
    return pitches.groupBy(*keys).agg(
        *[zero(F.avg(F.col(c).cast("double"))).alias(f"{n}_mean") for c, n in means.items() if c in pitches.columns],
        share("launch_speed", F.col("launch_speed") >= 95).alias("hard_hit_rate"),
        share("launch_speed_angle", F.col("launch_speed_angle") == 6).alias("barrel_rate"),
        F.count(F.lit(1)).cast("double").alias("pitch_count"))

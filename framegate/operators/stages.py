"""Four ordered stages of a capture: distance, eyebrows, final_checks, ready.

A row that completes a stage does not count for the next. stage_progression finds the
completing row of each stage with window functions over one partitioning by session;
SessionState is the same rules row by row, for streams and for sessions that are sent back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegate.operators.sampling import ordered_fold
from framegate.operators.windows import Names, hold_for, known, latch, run_length
from framegate.presets import STAGE_TOLD, STAGES, StageRules


def _within(value: Column, low: float, high: float) -> Column:
    """False where unknown."""
    return F.coalesce(known(value).between(low, high), F.lit(False))


def _marks(df: DataFrame, key: Names, us: str, tie: str, done: Column, after: str | None, name: str) -> DataFrame:
    """name: (us, tie) of the first row that completes the stage, on all rows of the key."""
    here = F.struct(us, tie)
    if after:
        done = done & (here > F.col(after))
    return df.withColumn(name, F.min(F.when(done, here)).over(Window.partitionBy(*key)))


def stage_progression(df: DataFrame, key: Names, us: str, tie: str, rules: StageRules = StageRules()) -> DataFrame:
    """Adds stage and stage_number after each row, and for each stage that a session
    completes done_distance, done_eyebrows and done_final_checks (time, or NULL).

    Takes iris_diameter, is_raised, centering_ratio, sharpness and brightness. An unknown
    measure fails its stage."""
    order = (us, tie)
    here = F.struct(us, tie)
    share = F.col("iris_diameter") / rules.reference_height
    band = rules.diameter
    df = latch(df, key, order, _within(share, band.low, band.high), ~_within(share, band.low - band.margin, band.high + band.margin), "_near")
    df = hold_for(df, key, order, F.col("_near"), us, rules.hold_us, "_held1")
    df = _marks(df, key, us, tie, F.col("_held1"), None, "_t1")

    df = df.withColumn("_in2", F.coalesce(here > F.col("_t1"), F.lit(False)))
    df = run_length(df, [*key, "_in2"], order, F.col("is_raised"), "_raised")
    df = df.withColumn("_raised", F.when(F.col("_in2"), F.col("_raised")).otherwise(0))
    df = _marks(df, key, us, tie, F.col("_raised") >= rules.raised_frames, "_t1", "_t2")

    df = df.withColumn("_in3", F.coalesce(here > F.col("_t2"), F.lit(False)))
    sharp = F.coalesce(known(F.col("sharpness")) >= rules.sharpness_min, F.lit(False))
    bright, centre = rules.brightness, F.coalesce(known(F.col("centering_ratio")), F.lit(float("inf")))
    strict = sharp & (centre <= rules.centering_max) & _within(F.col("brightness"), bright.low, bright.high)
    wide = sharp & (centre <= rules.centering_max + rules.centering_margin) & _within(F.col("brightness"), bright.low - bright.margin, bright.high + bright.margin)
    df = latch(df, [*key, "_in3"], order, strict, ~wide, "_fine")
    df = hold_for(df, [*key, "_in3"], order, F.col("_fine") & F.col("_in3"), us, rules.hold_us, "_held3")
    df = _marks(df, key, us, tie, F.col("_held3") & F.col("_in3"), "_t2", "_t3")

    number = F.lit(1)
    for mark in ("_t1", "_t2", "_t3"):
        number = number + F.coalesce(here >= F.col(mark), F.lit(False)).cast("int")
    df = df.withColumns(
        {
            "stage_number": number,
            "stage": F.element_at(F.array(*map(F.lit, STAGES)), number),
            "done_distance": F.col(f"_t1.{us}"),
            "done_eyebrows": F.col(f"_t2.{us}"),
            "done_final_checks": F.col(f"_t3.{us}"),
            "_count": F.when(here > F.col("_t2"), rules.raised_frames).otherwise(F.col("_raised")),
        }
    )
    return df.drop("_near", "_held1", "_in2", "_raised", "_in3", "_fine", "_held3", "_t1", "_t2", "_t3")


REPORT = ("stage", "stage_number", "progress", "message", "can_advance")


def stage_report(df: DataFrame, key: Names, us: str, tie: str, rules: StageRules = StageRules()) -> DataFrame:
    """stage_progression with progress in %, the message to show and whether it can advance.
    A row that completes a stage reports the start of the next."""
    df = stage_progression(df, key, us, tie, rules)
    order, band, bright = (us, tie), rules.diameter, rules.brightness
    share = known(F.col("iris_diameter") / rules.reference_height)
    on1 = F.col("stage_number") == 1
    # Holds restart with their stage: the clocks run over the rows of that stage alone.
    df = latch(df, [*key, "stage_number"], order, _within(share, band.low, band.high), ~_within(share, band.low - band.margin, band.high + band.margin), "_near")
    df = hold_for(df, [*key, "stage_number"], order, on1 & F.col("_near"), us, rules.hold_us, "_h1")
    first3 = F.col("done_eyebrows") == F.col(us)
    centre = F.coalesce(known(F.col("centering_ratio")), F.lit(float("inf")))
    sharp = F.coalesce(known(F.col("sharpness")) >= rules.sharpness_min, F.lit(False))
    strict = sharp & (centre <= rules.centering_max) & _within(F.col("brightness"), bright.low, bright.high)
    wide = sharp & (centre <= rules.centering_max + rules.centering_margin) & _within(F.col("brightness"), bright.low - bright.margin, bright.high + bright.margin)
    entered = F.col("stage_number") == 3
    df = df.withColumn("_counts3", F.coalesce(entered & ~first3, F.lit(False)))
    df = latch(df, [*key, "_counts3"], order, strict, ~wide, "_fine")
    df = hold_for(df, [*key, "_counts3"], order, F.col("_counts3") & F.col("_fine"), us, rules.hold_us, "_h3")
    progress = (
        F.when(on1, F.col("_h1_progress"))
        .when(F.col("stage_number") == 2, F.least(F.lit(100.0), F.col("_count") * 100.0 / rules.raised_frames))
        .when(entered, F.col("_h3_progress"))
        .otherwise(100.0)
    )
    second = F.col("stage_number") == 2
    (closer, back, right), (raise_, hold, good) = STAGE_TOLD["distance"], STAGE_TOLD["eyebrows"]
    center, tap, light, almost = STAGE_TOLD["final_checks"]
    rules = (
        (on1 & (share < band.low), closer), (on1 & (share > band.high), back), (on1, right),
        (second & ~F.coalesce("is_raised", F.lit(False)), raise_), (second & (F.col("_count") < rules.raised_frames / 2), hold), (second, good),
        (entered & (known(F.col("centering_ratio")) > rules.centering_max), center), (entered & (F.col("sharpness") < rules.sharpness_min), tap),
        (entered & (F.col("brightness") < bright.low), light), (entered, almost),
    )
    message = F.coalesce(*[F.when(holds, text) for holds, text in rules], F.lit(STAGE_TOLD["ready"]))
    df = df.withColumns({"progress": progress, "message": message})
    df = df.withColumn("can_advance", F.col("progress") >= 100.0)
    return df.drop("_near", "_h1", "_h1_progress", "_counts3", "_fine", "_h3", "_h3_progress", "_count", "_held1_progress", "_held3_progress")


@dataclass
class SessionState:
    """What the stage rules remember of a session."""

    stage: int = 0
    since1: int | None = None
    raised: int = 0
    confirmed: bool = False
    since3: int | None = None

    def back_to(self, stage: str) -> None:
        """Sends the session back. Holds restart; raised frames and their confirmation stay."""
        self.stage, self.since1, self.since3 = STAGES.index(stage), None, None

    def advance(self, rules: StageRules, us: int, near: bool, wide: bool, up: bool, fine: bool, loose: bool) -> int:
        """Applies one row and returns the number of the stage after it. near and wide: the
        distance lies in its band, or in the band with its margin; fine and loose: so do the
        last checks."""
        if self.stage == 0:
            if near if self.since1 is None else wide:
                self.since1 = us if self.since1 is None else self.since1
                self.stage += us - self.since1 >= rules.hold_us
            else:
                self.since1 = None
        elif self.stage == 1:
            if self.confirmed:
                self.stage += 1
            elif up:
                self.raised += 1
                self.confirmed = self.raised >= rules.raised_frames
                self.stage += self.confirmed
            else:
                self.raised = 0
        elif self.stage == 2:
            if fine if self.since3 is None else loose:
                self.since3 = us if self.since3 is None else self.since3
                self.stage += us - self.since3 >= rules.hold_us
            else:
                self.since3 = None
        return self.stage

    def step(self, row: dict, rules: StageRules) -> str:
        """Applies one row and returns the stage after it."""
        share, band, b = _num(row["iris_diameter"]) / rules.reference_height, rules.diameter, rules.brightness
        centre, sharp, bright = _num(row["centering_ratio"]), _num(row["sharpness"]) >= rules.sharpness_min, _num(row["brightness"])
        return STAGES[
            self.advance(
                rules, row["us"], band.low <= share <= band.high, band.low - band.margin <= share <= band.high + band.margin, bool(row["is_raised"]),
                centre <= rules.centering_max and sharp and b.low <= bright <= b.high,
                centre <= rules.centering_max + rules.centering_margin and sharp and b.low - b.margin <= bright <= b.high + b.margin,
            )
        ]


def _num(value) -> float:
    return float("nan") if value is None else float(value)


def stage_regression(df: DataFrame, key: Names, us: str, tie: str, rules: StageRules = StageRules()) -> DataFrame:
    """(tie, stage) after each row where return_to, if it names a stage, first sends the session
    back there. Measures are tested by Spark; what is left to a fold over sorted columns is
    the session's state."""
    share, band, bright = F.col("iris_diameter") / rules.reference_height, rules.diameter, rules.brightness
    sharp = F.coalesce(known(F.col("sharpness")) >= rules.sharpness_min, F.lit(False))
    centre = F.coalesce(known(F.col("centering_ratio")), F.lit(float("inf")))
    marks = {
        "_near": _within(share, band.low, band.high), "_wide": _within(share, band.low - band.margin, band.high + band.margin), "_up": F.coalesce("is_raised", F.lit(False)),
        "_fine": sharp & (centre <= rules.centering_max) & _within(F.col("brightness"), bright.low, bright.high),
        "_loose": sharp & (centre <= rules.centering_max + rules.centering_margin) & _within(F.col("brightness"), bright.low - bright.margin, bright.high + bright.margin),
    }
    rows, named = df.select(*key, us, tie, "return_to", *[c.alias(n) for n, c in marks.items()]), list(marks)

    def walk(state: SessionState, rows: dict[str, list]) -> list[list]:
        told = []
        for back, *row in zip(rows["return_to"], rows[us], *(rows[m] for m in named), strict=True):
            if back:
                state.back_to(back)
            told.append(STAGES[state.advance(rules, *row)])
        return [rows[tie], told]

    kind = dict(df.dtypes)[tie]
    return ordered_fold(rows, key, [us, tie], SessionState, walk, f"{tie} {kind}, stage string")


def failing(rules: StageRules = StageRules()) -> Column:
    """The condition that keeps a row of stage_progression in its stage; NULL if none does."""
    centre, bright = known(F.col("centering_ratio")), rules.brightness
    third = (
        F.when(~F.coalesce(centre <= rules.centering_max, F.lit(False)), "centering")
        .when(~F.coalesce(known(F.col("sharpness")) >= rules.sharpness_min, F.lit(False)), "focus")
        .when(~_within(F.col("brightness"), bright.low, bright.high), "lighting")
    )
    near = _within(F.col("iris_diameter") / rules.reference_height, rules.diameter.low, rules.diameter.high)
    number = F.col("stage_number")
    return F.when((number == 1) & ~near, "distance").when((number == 2) & ~F.coalesce("is_raised", F.lit(False)), "eyebrows").when(number == 3, third)


def stage_funnel(df: DataFrame, key: Names, us: str, group: str, rules: StageRules = StageRules()) -> DataFrame:
    """From stage_progression: for each group (and 'all') and stage, the sessions that reached
    it, those lost before it, and the mean and median seconds spent in the stage before it;
    and, of sessions stuck in the stage, the condition that failed in most of their rows there
    (a tie: the first by name). The median is a session's, exact up to 10,000 sessions and
    approximate beyond."""
    by = list(dict.fromkeys([*key, group]))
    held = df.withColumn("reached", F.max("stage_number").over(Window.partitionBy(*key)))
    stuck = held.filter((F.col("stage_number") == F.col("reached")) & (F.col("reached") < len(STAGES))).withColumn("failed", failing(rules))
    counts = stuck.filter("failed is not null").rollup("stage_number", "failed", group).agg(F.count("*").alias("n"), F.grouping(group).alias("every"), F.grouping("failed").alias("whole"))
    counts = counts.filter("whole = 0").groupBy("stage_number", group, "every").agg(F.min_by("failed", F.struct(-F.col("n"), "failed")).alias("top_failing"))
    per = df.groupBy(*by).agg(
        F.min(us).alias("began"), F.max("stage_number").alias("reached"),
        F.max("done_distance").alias("d1"), F.max("done_eyebrows").alias("d2"), F.max("done_final_checks").alias("d3"),
    )
    took = F.array(F.lit(None).cast("long"), F.col("d1") - F.col("began"), F.col("d2") - F.col("d1"), F.col("d3") - F.col("d2"))
    rows = per.select(group, "reached", F.posexplode(took).alias("at", "took")).withColumn("stage_number", F.col("at") + 1)
    came = F.col("reached") >= F.col("stage_number")
    out = rows.withColumn("came", came).rollup("stage_number", group).agg(
        F.count_if("came").alias("sessions"), F.count("*").alias("started"), (F.avg("took") / 1e6).alias("mean_seconds"),
        (F.percentile_approx("took", 0.5, 10_000) / 1e6).alias("median_seconds"), F.grouping(group).alias("every"),
    ).filter(F.col("stage_number").isNotNull())
    top = counts.select(F.col("stage_number").alias("at"), F.col(group).alias("of"), F.col("every").alias("whole"), "top_failing")
    met = out.join(top, (F.col("stage_number") == F.col("at")) & F.col(group).eqNullSafe(F.col("of")) & (F.col("every") == F.col("whole")), "left")
    return met.select(
        F.when(F.col("every") == 1, "all").otherwise(F.col(group).cast("string")).alias("grp"), "stage_number",
        F.element_at(F.array(*map(F.lit, STAGES)), F.col("stage_number")).alias("stage"),
        "sessions", (F.col("started") - F.col("sessions")).alias("lost"), "mean_seconds", "median_seconds", "top_failing",
    )

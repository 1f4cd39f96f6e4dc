"""Scores, statuses and messages of a frame, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framegate.presets import CENTERING, DISTANCE, FOCUS, GATE, GUIDANCE, GUIDANCE_VARIANTS, LIGHTING, LIVE, LOSS, PARTIAL, REPORT, STABLE_SECONDS, TOLD


def _zero(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)


def _graded(fine: Column, near: Column, share: Column, over: Column, off: Column, warn_below: float, warn_above: float, name: str) -> dict[str, Column]:
    """Score, status and feedback of a measure that may be fine, below or above: off is how
    far a fine one is from its ideal, share what part of the lower bound a low one reaches,
    over by what part a high one passes the upper bound."""
    ok, low, high = TOLD[name]
    return {
        f"{name}_score": F.when(fine, _zero(100 - off * LOSS)).when(near, PARTIAL * share).otherwise(_zero(PARTIAL - PARTIAL * over)),
        f"{name}_status": F.when(fine, "ok").when(F.when(near, share > warn_below).otherwise(over < warn_above), "warn").otherwise("fail"),
        f"{name}_feedback": F.when(fine, ok).when(near, low).otherwise(high),
    }


def distance_score(diameter: Column, width: Column, height: Column) -> dict[str, Column]:
    """Score, status and feedback of an iris diameter in a frame."""
    d, ref = DISTANCE, F.least(width, height)
    low, high = ref * d["low"], ref * d["high"]
    off = F.abs(diameter - (low + high) / 2) / ((high - low) / 2)
    fine = diameter.between(low * d["ok_from"], high)
    return _graded(fine, diameter < low, diameter / low, (diameter - high) / high, off, d["warn_below"], d["warn_above"], "distance")


def lighting_score(brightness: Column) -> dict[str, Column]:
    g = LIGHTING
    off = F.abs(brightness - g["ideal"]) / g["half"]
    fine = brightness.between(g["low"], g["high"])
    return _graded(fine, brightness < g["low"], brightness / g["low"], (brightness - g["high"]) / g["above"], off, g["warn_below"], g["warn_above"], "lighting")


def centering_score(x: Column, y: Column, width: Column, height: Column) -> dict[str, Column]:
    across, down = x - width / 2, y - height / 2
    ratio = F.least(F.lit(1.0), F.sqrt(across * across + down * down) / (F.least(width, height) / 2))  # hypot's last digit is any engine's own
    score = _zero((1 - ratio) * 100)
    status = F.when(score >= CENTERING["ok"], "ok").when(score >= CENTERING["warn"], "warn").otherwise("fail")
    return {"centering_ratio": ratio, "centering_score": score, "centering_status": status}


def focus_status(focus: Column, crop_size: Column, ok: float = FOCUS["ok"], warn: float = FOCUS["warn"], least: int = FOCUS["least_pixels"]) -> dict[str, Column]:
    """Status of a smoothed focus; without a crop, or with one below least pixels, it fails."""
    none, small = crop_size.isNull(), crop_size < least
    sharp, almost, blurry = TOLD["focus"]
    return {
        "focus_score": F.when(none | small, 0.0).otherwise(focus),
        "focus_status": F.when(none | small, "fail").when(focus >= ok, "ok").when(focus >= warn, "warn").otherwise("fail"),
        "focus_feedback": F.when(none, blurry).when(small, TOLD["distance"][1]).when(focus >= ok, sharp).when(focus >= warn, almost).otherwise(blurry),
    }


def no_detection_row(detected: Column, columns: dict[str, Column]) -> dict[str, Column]:
    """columns, but for an undetected frame: scores 0, statuses fail, ratio 1."""
    blank = {"score": F.lit(0.0), "status": F.lit("fail"), "feedback": F.lit(TOLD["no_face"]), "ratio": F.lit(1.0), "brightness": F.lit(0.0)}
    return {name: F.when(detected, c).otherwise(blank[name.rsplit("_", 1)[-1]]) for name, c in columns.items()}


def score_gate(detected: Column, distance: Column, lighting: Column, centering: Column, focus: Column) -> Column:
    return detected & (distance >= GATE["distance"]) & (lighting >= GATE["lighting"]) & (centering >= GATE["centering"]) & (focus >= GATE["focus"])


def traffic_light(detected: Column, gate: Column) -> Column:
    return F.when(~detected, "red").when(gate, "green").otherwise("yellow")


def ready_predicate(detected: Column, crop: Column, focus: Column, locked: Column, distance: Column, lighting: Column, angle: Column) -> Column:
    """All that must hold for a frame to count towards the countdown; centering is not asked."""
    return detected & crop & (focus == "ok") & locked & (distance == "ok") & (lighting != "fail") & angle.isin("optimal", "unavailable")


def live_guidance(
    detected: Column, crop: Column, focus: Column, locked: Column, angle_known: Column, angle_ok: Column,
    distance: Column, distance_feedback: Column, centering: Column, lighting: Column, countdown: Column,
) -> Column:
    """The one message to show while a camera runs; the first rule that applies."""
    fine = (distance == "ok") & (centering == "ok") & (lighting == "ok")
    rules = (
        (~detected, LIVE["undetected"]),
        (~crop, LIVE["no_crop"]),
        (focus == "fail", LIVE["focus_fail"]),
        (focus == "warn", LIVE["focus_warn"]),
        (~locked, LIVE["not_locked"]),
        (angle_known & ~angle_ok, LIVE["angle"]),
        (distance == "fail", distance_feedback),
        (centering == "fail", LIVE["centering"]),
        (lighting == "fail", LIVE["lighting"]),
        (fine & countdown.isNull(), LIVE["perfect"]),
        (countdown.isNotNull(), F.concat(F.lit(LIVE["countdown"]), countdown.cast("string"))),
    )
    return F.coalesce(*[F.when(holds, text) for holds, text in rules], F.lit(LIVE["almost"]))


def report_feedback(detected: Column, stable_s: Column, needed_s: int = STABLE_SECONDS, **parts: Column) -> Column:
    """Failures first, then warnings, each as distance, centering, lighting, focus; then how
    long to hold. parts: <name>_status and <name>_feedback of the four."""
    out = F.when(detected.isNull(), REPORT["none"]).when(~detected, REPORT["undetected"])
    for level in ("fail", "warn"):
        for name in ("distance", "centering", "lighting", "focus"):
            out = out.when(parts[f"{name}_status"] == level, parts[f"{name}_feedback"])
    left = F.concat(F.lit(REPORT["steady"]), (F.lit(needed_s) - stable_s).cast("string"), F.lit("s"))
    return out.when((stable_s > 0) & (stable_s < needed_s), left).otherwise(REPORT["perfect"])


def condition_priority(failed: Column) -> Column:
    """Of an array of failing conditions, the most urgent one; NULL if none is known."""
    order = F.array(*[F.lit(n) for n, _ in GUIDANCE])
    return F.get(F.filter(order, lambda n: F.array_contains(failed, n)), F.lit(0))


def guidance(condition: Column, variant: Column | None = None) -> Column:
    """What to say of a condition; variant: tooFar, tooClose, dark, tooBright or perfect."""
    out = F.when(condition.isNull(), "Hold Still")
    if variant is not None:
        for name, kind, text in GUIDANCE_VARIANTS:
            out = out.when((condition == name) & (variant == kind), text)
    for name, text in GUIDANCE:
        out = out.when(condition == name, text)
    return out

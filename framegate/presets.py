"""Named thresholds. Every operator takes its own; these are the defaults.

Fixed values of the capture rules, stated here once.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Band:
    """Inclusive bounds, and the margin that a running state may leave them by."""

    low: float
    high: float
    margin: float = 0.0


PHONE_ANGLE = Band(25.0, 50.0, 5.0)
HOLD_MS = 800
COUNTDOWN_MS = 3000
GOOD_FRAMES = 5
ANALYSIS_GAP_MS = 100
SUMMARY_GAP_MS = 10_000
SPEECH_GAP_MS = 1500
SPEECH_REPEAT_MS = 3000
BURST_MIN_SHARPNESS = 140.0
#: Six frames, one every 40 ms.
BURST_US = 240_000
CANDIDATE_RATIO = Band(0.02, 0.45)
CANDIDATE_IDEAL = 0.14
TTL_SECONDS = 3600
QUOTAS = {"process": 5, "download": 10}
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MIN_SIDE, MAX_SIDE = 64, 4096
MIN_PIXELS = 12_000_000
SMA = {"diameter": 5, "brightness": 10, "focus": 3}
CONDITIONS = ("noFace", "distance", "eyebrows", "centering", "focus", "lighting")
ABORTS = ("noFace", "distance", "centering", "other")
#: Conditions from the most to the least urgent, with what the user is told.
GUIDANCE = (
    ("eyebrowsRaised", "Raise Your Eyebrows"),
    ("phoneAngleOk", "Aim Light at Hairline"),
    ("distanceOk", "Move Closer"),
    ("eyeCentered", "Center Your Eye"),
    ("lightingAdequate", "More Light Needed"),
    ("focusSharp", "Tap to Focus"),
    ("faceDetected", "Position Your Face"),
)
#: What is said instead where it is known how a condition fails, or that it is met.
GUIDANCE_VARIANTS = (
    ("distanceOk", "tooClose", "Move Back"),
    ("distanceOk", "perfect", "Perfect Distance"),
    ("lightingAdequate", "tooBright", "Too Much Light"),
    ("lightingAdequate", "perfect", "Good Lighting"),
)


#: Fixed values of the frame scores: shares of the frame's short side, brightness, focus.
DISTANCE = {"low": 0.07, "high": 0.24, "ok_from": 0.93, "warn_below": 0.4, "warn_above": 0.6}
LIGHTING = {"low": 100, "high": 180, "ideal": 140, "half": 40, "above": 75, "warn_below": 0.7, "warn_above": 0.3}
CENTERING = {"ok": 20, "warn": 10}
FOCUS = {"ok": 100.0, "warn": 50.0, "least_pixels": 16}
LOSS, PARTIAL = 30, 70
GATE = {"distance": 60, "lighting": 50, "centering": 35, "focus": 80}
STABLE_SECONDS = 3
#: Fixed values of iris geometry: shares of the frame, and of the crop around an iris.
IRIS = {"least": 0.008, "most": 0.12, "lowest": 0.7}
CROP = {"padding": 2.4, "least": 32}
NATIVE = {"least": 64.0, "margin": 0.05, "iris_scale": 1.6}
#: Fixed values of raster focus: means outside [DARK, GLARE] score 0; weights of its terms.
DARK, GLARE = 30.0, 240.0
FOCUS_VARIANCE, FOCUS_GRADIENT = 0.7, 3
LUMA = (0.299, 0.587, 0.114)

#: Fixed texts: what a user is told.
TOLD = {
    "distance": ("Perfect distance", "Move closer", "Move back"),
    "lighting": ("Good lighting", "Too dark", "Too bright"),
    "focus": ("Sharp", "Almost sharp", "Blurry"),
    "no_face": "No face detected",
}
LIVE = {
    "undetected": "Align one eye in the circle",
    "no_crop": "Hold steady...",
    "focus_fail": "Image is blurry — hold still to focus",
    "focus_warn": "Almost sharp — keep still...",
    "not_locked": "Perfect focus. Hold still...",
    "angle": "Aim light at hairline — tilt phone back",
    "centering": "Center your eye in the circle",
    "lighting": "Move to better lighting",
    "perfect": "Perfect. Hold still...",
    "countdown": "Hold still... ",
    "almost": "Almost there...",
}
REPORT = {"none": "Initializing...", "undetected": "Position your eye in frame", "steady": "Hold steady... ", "perfect": "Perfect! Hold steady..."}
STAGE_TOLD = {
    "distance": ("Move Closer", "Move Back", "Perfect Distance"),
    "eyebrows": ("Raise Your Eyebrows", "Hold Them Raised...", "Good! Keep Going"),
    "final_checks": ("Center Your Eye", "Tap to Focus", "Move to Better Light", "Almost Ready..."),
    "ready": "Hold Still!",
}


@dataclass(frozen=True)
class StageRules:
    """What the four stages of a capture ask for. Times in microseconds."""

    reference_height: float = 1080.0
    diameter: Band = Band(0.08, 0.12, 0.02)
    hold_us: int = HOLD_MS * 1000
    raised_frames: int = 30
    centering_max: float = 0.3
    centering_margin: float = 0.05
    sharpness_min: float = 8.0
    brightness: Band = Band(60.0, 200.0, 10.0)


STAGES = ("distance", "eyebrows", "final_checks", "ready")

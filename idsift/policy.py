"""Policy and threshold values: small driver-side configuration."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

# They must equal the published development policy.
SIGNAL_WEIGHTS = {
    "blacklist": 35,
    "duplicate_identity": 15,
    "face": 15,
    "mrz": 8,
    "cross_fields": 8,
    "dates": 5,
    "tampering": 5,
    "liveness": 4,
    "metadata": 2,
    "format": 3,
}
REQUIRED_SIGNALS = ["blacklist", "face", "mrz", "cross_fields", "dates", "tampering", "liveness"]
QUALITY_THRESHOLDS = {
    "min_width": 600,
    "min_height": 350,
    "min_laplacian_variance": 45.0,
    "min_brightness": 55.0,
    "max_brightness": 248.0,
    "max_saturated_fraction": 0.45,
}
FACE_THRESHOLDS = {
    "cosine_threshold": 0.60,
    "min_face_size": 60,
    "min_face_laplacian": 20.0,
    "min_face_brightness": 35.0,
    "max_face_brightness": 245.0,
}
SEQUENCE_LIMITS = {
    "max_frames": 12,
    "max_timestamp_ms": 20000,
    "min_blink_frames": 5,
    "max_frame_gap_ms": 500,
    "min_blink_duration_ms": 60,
    "max_blink_duration_ms": 500,
    "min_texture_contrast": 8,
    "max_periodic_ratio": 0.45,
    "suspicious_score": 0.5,
}
VALIDATION_RULES = {"max_age": 120, "max_expiry_horizon_years": 20}
NUMBER_PATTERNS = {"UTO": "^[A-Z][0-9]{7}$"}
EXTRA_COUNTRY_CODES = [
    "UTO", "D", "UNO", "UNA", "UNK", "XOM", "XCC", "XPO", "XXA", "XXB", "XXC", "XXX",
]
REFERENCE_DATE = "2026-10-03"
FINDING_SCORE = 0.55
PIXEL_THRESHOLD = 0.5
IMAGE_FRACTION_THRESHOLD = 0.02


@dataclass(frozen=True)
class RiskPolicy:
    """Weights and thresholds of the weighted score; refuses inconsistent input."""

    version: str = "synthetic-weighted-v1"
    medium_threshold: float = 15.0
    high_threshold: float = 35.0
    weights: dict = field(default_factory=lambda: dict(SIGNAL_WEIGHTS))
    required_signals: list = field(default_factory=lambda: list(REQUIRED_SIGNALS))

    def __post_init__(self) -> None:
        problems = []
        values = list(self.weights.values())
        if not self.version:
            problems.append("version is empty")
        if set(self.weights) != set(SIGNAL_WEIGHTS):
            problems.append("weights must name every signal exactly once")
        elif not all(math.isfinite(v) and 0 <= v <= 100 for v in values):
            problems.append("weights must be finite and within 0..100")
        elif abs(math.fsum(values) - 100) > 1e-8:
            problems.append("weights must add up to 100")
        if not 0 < self.medium_threshold < self.high_threshold <= 100:
            problems.append("thresholds must satisfy 0 < medium < high <= 100")
        names = list(self.required_signals)
        if not names or len(names) != len(set(names)):
            problems.append("required signals must be present and unique")
        elif any(self.weights.get(n, 0) <= 0 for n in names):
            problems.append("required signals need a positive weight")
        if problems:
            raise ValueError("; ".join(problems))

    @property
    def digest(self) -> str:
        text = json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()

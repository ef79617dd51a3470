"""Limits and thresholds of the travel-document engine, in one place."""

from __future__ import annotations

# files and pages
MAX_FILE_BYTES = 15 * 1024 * 1024
MAX_PAGES = 5
MAX_PIXELS = 25_000_000
RENDER_SCALE, PRIMARY_SCALE, SECONDARY_SCALE, PREVIEW_SCALE = 2.5, 2.7, 2.5, 1.8
OCR_WIDTH = 1800

# machine-readable zones
MAX_LINE_VARIANTS = 32
MAX_NUMBER_VARIANTS = 30
MIN_MRZ_LINE = 20
SOON_DAYS = 30

# verdicts
VERIFIED_FROM, WARNINGS_FROM, REVIEW_MEDIUM_FROM = 92, 78, 70
NAME_SIMILARITY, TOKEN_SIMILARITY = 0.82, 0.84
LOW_PRIMARY_SCORE, LOW_SECONDARY_SCORE = 40, 35

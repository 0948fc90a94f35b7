"""Lookup tables, physical constants and default parameters.

These must hold exactly these values for results to be right.
"""

# Physical constants (km, s). The two mu values belong to different formulas.
EARTH_MU_KM3_S2 = 398600.4418
WGS72_MU_KM3_S2 = 398600.8
WGS72_RADIUS_KM = 6378.135
WGS72_J2 = 0.001082616
WGS72_J3 = -0.00000253881
WGS72_J4 = -0.00000165597
EARTH_EQUATORIAL_RADIUS_M = 6_378_137
CURVATURE_SAFETY_FACTOR = 8.0
POSITION_PADDING_KM = 1e-9

# Screening defaults.
SCREENING_STEP_SECONDS = 60
SCREENING_HORIZON_SECONDS = 6 * 3600
SCREENING_DISTANCE_KM = 10.0
SCREENING_MAX_RELATIVE_SPEED_KM_S = 16.0
SCREENING_CHUNK_SECONDS = 900
SCREENING_MAX_OBJECTS = 40_000
SCREENING_MAX_PROPAGATIONS = 12_000_000
SCREENING_MAX_CHUNK_UNIQUE_CANDIDATES = 4_000_000
LINEAR_HALF_WINDOW_SECONDS = 300.0
CONTINUITY_RESOLUTION_SECONDS = 0.01

# Ephemeris quality limits in hours (inclusive) and status order.
EPHEMERIS_WARNING_HOURS = 12.0
EPHEMERIS_STALE_HOURS = 24.0
EPHEMERIS_MAX_HOURS = 72.0
EPHEMERIS_STATUSES = ("fresh", "aging", "stale", "expired")

# Canonical source priority; every other source is 9.
SOURCE_PRIORITY = {"space-track": 0, "celestrak": 1}
OTHER_SOURCE_PRIORITY = 9

# Object type spellings.
OBJECT_TYPES = {
    "PAY": "PAYLOAD",
    "PAYLOAD": "PAYLOAD",
    "R/B": "ROCKET_BODY",
    "ROCKET BODY": "ROCKET_BODY",
    "ROCKET_BODY": "ROCKET_BODY",
    "DEB": "DEBRIS",
    "DEBRIS": "DEBRIS",
    "UNK": "UNKNOWN",
    "UNKNOWN": "UNKNOWN",
}
DISPLAY_KINDS = ("PAYLOAD", "DEBRIS", "ROCKET_BODY", "UNKNOWN")
COUNTED_OBJECT_TYPES = ("PAYLOAD", "ROCKET_BODY", "DEBRIS", "UNKNOWN")

OPERATIONAL_STATUS_LABELS = {
    "+": "Operational",
    "-": "Nonoperational",
    "P": "Partially Operational",
    "B": "Backup / Standby",
    "S": "Spare",
    "X": "Extended Mission",
    "D": "Decayed",
    "?": "Unknown",
}

# Feed record fields.
SATCAT_REQUIRED_FIELDS = ("OBJECT_NAME", "NORAD_CAT_ID", "OBJECT_TYPE")
SATCAT_FIELDS = (
    "OBJECT_NAME", "OBJECT_ID", "NORAD_CAT_ID", "OBJECT_TYPE", "OPS_STATUS_CODE",
    "OWNER", "LAUNCH_DATE", "LAUNCH_SITE", "DECAY_DATE", "PERIOD", "INCLINATION",
    "APOGEE", "PERIGEE", "RCS", "DATA_STATUS_CODE", "ORBIT_CENTER", "ORBIT_TYPE",
)
OMM_FIELDS = (
    "NORAD_CAT_ID", "OBJECT_NAME", "OBJECT_ID", "OBJECT_TYPE", "COUNTRY_CODE",
    "LAUNCH_DATE", "DECAY_DATE", "EPOCH", "INCLINATION", "RA_OF_ASC_NODE",
    "ECCENTRICITY", "ARG_OF_PERICENTER", "MEAN_ANOMALY", "MEAN_MOTION",
    "MEAN_MOTION_DOT", "MEAN_MOTION_DDOT", "BSTAR", "ELEMENT_SET_NO",
    "EPHEMERIS_TYPE", "REV_AT_EPOCH", "CLASSIFICATION_TYPE",
)
OMM_REQUIRED_FIELDS = (
    "INCLINATION", "RA_OF_ASC_NODE", "ECCENTRICITY", "ARG_OF_PERICENTER",
    "MEAN_ANOMALY", "MEAN_MOTION",
)
GROUP_NAME_PATTERN = "^[A-Z0-9_-]+$"
FEED_MAX_RECORDS_SCHEDULED = 40_000
FEED_MAX_RECORDS_MANUAL = 500
CURRENT_GP_MAX_AGE_DAYS = 10

# Group name -> tags, each ("namespace", "tag").
GROUP_TAGS = {
    "STATIONS": (("special", "space_station"),),
    "WEATHER": (("mission", "weather"),),
    "RESOURCE": (("mission", "earth_observation"),),
    "SARSAT": (("mission", "search_and_rescue"),),
    "DMC": (("mission", "disaster_monitoring"), ("mission", "earth_observation")),
    "TDRSS": (("mission", "data_relay"), ("mission", "communications")),
    "ARGOS": (("mission", "data_collection"),),
    "PLANET": (("mission", "earth_observation"), ("constellation", "planet")),
    "INTELSAT": (("mission", "communications"), ("operator", "intelsat")),
    "SES": (("mission", "communications"), ("operator", "ses")),
    "EUTELSAT": (("mission", "communications"), ("operator", "eutelsat")),
    "TELESAT": (("mission", "communications"), ("operator", "telesat")),
    "STARLINK": (("mission", "communications"), ("constellation", "starlink")),
    "ONEWEB": (("mission", "communications"), ("constellation", "oneweb")),
    "QIANFAN": (("mission", "communications"), ("constellation", "qianfan")),
    "HULIANWANG": (("mission", "communications"), ("constellation", "hulianwang")),
    "KUIPER": (("mission", "communications"), ("constellation", "kuiper")),
    "IRIDIUM-NEXT": (("mission", "communications"), ("constellation", "iridium_next")),
    "ORBCOMM": (("mission", "communications"), ("constellation", "orbcomm")),
    "GLOBALSTAR": (("mission", "communications"), ("constellation", "globalstar")),
    "AMATEUR": (("mission", "amateur_radio"),),
    "GNSS": (("mission", "navigation"),),
    "GPS-OPS": (("mission", "navigation"), ("constellation", "gps")),
    "GLO-OPS": (("mission", "navigation"), ("constellation", "glonass")),
    "GALILEO": (("mission", "navigation"), ("constellation", "galileo")),
    "BEIDOU": (("mission", "navigation"), ("constellation", "beidou")),
    "SBAS": (("mission", "navigation"), ("mission", "augmentation")),
    "SCIENCE": (("mission", "scientific"),),
    "GEODETIC": (("mission", "scientific"), ("mission", "geodetic")),
    "EDUCATION": (("mission", "education"),),
    "MILITARY": (("mission", "military"),),
    "RADAR": (("special", "radar_calibration"),),
    "CUBESAT": (("form_factor", "cubesat"),),
}

# Operations: providers, source labels, intervals and retry policy (seconds).
PROVIDERS = ("satcat", "celestrak", "space-track")
SCREENING_SOURCES = ("canonical", "celestrak", "space-track", "other")
PROVIDER_INTERVAL_SECONDS = {"satcat": 43_200, "celestrak": 7_200, "space-track": 3_600}
SCREENING_INTERVAL_SECONDS = 14_400
FEED_RETRY = {"initial": 60, "multiplier": 2, "maximum": 1_800}
SCREENING_RETRY = {"initial": 900, "multiplier": 2, "maximum": 3_600}
DURATION_BOUNDS = (1, 5, 15, 30, 60, 120, 300, 600, 1800, 3600, float("inf"))
RECORD_RESULTS = ("received", "matched", "imported", "unmatched")
STALE_AFTER_SECONDS = {"satcat": 86_400, "celestrak": 14_400, "space-track": 7_200}
COVERAGE_ALERT_RATIO = 0.75
RECENT_RUN_SECONDS = 900
INCREASE_WINDOW = "15 minutes"
LOG_LEVEL_PATTERN = "(?i)(error|exception|traceback|failed|warning|warn)"
LOG_RETENTION_HOURS = 168

# Run counters exposed as latest-run metrics.
RUN_METRIC_FIELDS = (
    "objects", "samples", "chunk_count", "chunk_seconds", "propagation_attempts",
    "propagation_failures", "expired_skips", "raw_candidates", "unique_candidates",
    "refinement_attempts", "refinement_failures", "duplicate_events_suppressed",
    "suppressed_shared_pairs", "max_chunk_raw_candidates",
    "max_chunk_unique_candidates", "max_chunk_refinement_attempts", "duration_ms",
)

# Trajectory and lookup limits.
MAX_TARGET_OBJECTS = 16
MIN_STEP_SECONDS = 10
MAX_WINDOW_HOURS = 24
MAX_POINTS_PER_OBJECT = 1000
SEARCH_MIN_CHARS = 2
SEARCH_MAX_RESULTS = 12
TCA_REPLAY_SECONDS = 3600
TCA_DISPLAY_SECONDS = 300
PRIORITY_EVENTS = 5

# Brief validation: allowed values, limits and content patterns.
BRIEF_EVIDENCE_FIELDS = (
    "primary_role", "primary_object_type", "primary_element_source",
    "primary_element_epoch", "secondary_role", "secondary_object_type",
    "secondary_element_source", "secondary_element_epoch", "tca",
    "miss_distance_km", "relative_velocity_km_s", "method", "window_start",
    "window_end", "run_completed_at",
)
BRIEF_RECOMMENDED_CHECKS = (
    "verify_ephemeris_freshness",
    "review_event_evolution",
    "confirm_object_identification",
    "monitor_next_screening",
    "escalate_for_human_review",
)
BRIEF_LIMITATIONS = (
    "ai_explanation_not_orbital_calculation",
    "persisted_data_may_change_after_rescreening",
    "human_review_required",
)
BRIEF_SUMMARY_CHARS = (20, 320)
BRIEF_OBSERVATION_CHARS = (15, 180)
BRIEF_LIST_ITEMS = (1, 3)
BRIEF_FINISH_REASONS = ("stop", "length", "content_filter", "tool_calls")
THINK_TAG_PATTERN = r"(?i)</?think\b"
MANEUVER_PATTERN = (
    r"(?i)\b(?:perform|execute|initiate|conduct|schedule|prescribe|"
    r"(?<!not )recommend(?:s|ed|ing)?|should|must)\b"
    r"[^.]{0,80}\b(?:maneuver|manoeuvre|burn|alter(?:ing)? (?:the )?orbit|"
    r"orbital change|collision avoidance action)\b|\balter (?:the )?orbit\b"
)
PROBABILITY_PATTERN = (
    r"(?i)\b(?:has|assigns|reports|estimates)\s+(?:a )?"
    r"(?:collision probability|probability of collision)\b|"
    r"\b(?<!no )(?:collision probability|probability of collision)\s+"
    r"(?:is|appears|remains|equals|was)\s+(?!not\b|unknown\b|unavailable\b)"
)
RISK_PATTERN = (
    r"(?i)\b(?:low|medium|moderate|high|critical|severe)\s+(?:risk|severity)\b|"
    r"\b(?:risk|severity)\s+(?:is|appears|remains|equals)\s+"
    r"(?:low|medium|moderate|high|critical|severe)\b"
)

"""Fixed values and explicit schemas: statuses, categories, actions, rules, incidents."""

from __future__ import annotations

# The statuses that a run record may name, and what each stands for. Any other counts as Failed.
FAILED, SUCCEEDED, RUNNING, CANCELLED = "Failed", "Succeeded", "Running", "Cancelled"
STATUSES = {
    "Failed": FAILED,
    "Succeeded": SUCCEEDED,
    "Running": RUNNING,
    "Cancelled": CANCELLED,
    "Canceled": CANCELLED,
}

# Error categories.
CATEGORIES = (
    "transient",
    "auth",
    "infra",
    "schema",
    "permission",
    "data_quality",
    "source_missing",
    "unknown",
)

# Actions and their labels.
AUTO_RERUN, ALERT_SENT, MAX_RETRIES, INVESTIGATING = "auto_rerun", "alert_sent", "max_retries_exceeded", "investigating"
ACTION_LABELS = {
    "auto_rerun": "AUTO-FIXED",
    "alert_sent": "ESCALATED",
    "max_retries_exceeded": "MAX RETRIES",
    "investigating": "INVESTIGATING",
}

# Error rules in their order; the first whose pattern is found in the text decides.
# (pattern, category, fixable without a person)
ERROR_RULES = (
    ("OperationTimeout", "transient", True),
    ("TooManyRequests|429|RateLimitExceeded", "transient", True),
    ("AuthenticationFailed|TokenExpired|401", "auth", True),
    ("ServiceUnavailable|503|Connection refused", "infra", True),
    ("GatewayTimeout|504|BadGateway|502|Connection reset|network error|host unreachable", "transient", True),
    ("SchemaError|ColumnNotFound|TypeMismatch|DataTypeConversion", "schema", False),
    ("FileNotFound|TableNotFoundException|ResourceNotFound|404", "source_missing", False),
    ("AccessDenied|Forbidden|403|Unauthorized|PermissionDenied", "permission", False),
    ("UniqueConstraintViolation|DuplicateKey|NullConstraint|CheckConstraint", "data_quality", False),
)

# Phrases of the troubleshooting guide, in its order. (phrase, category, fixable, minutes to wait)
PHRASE_RULES = (
    ("DeltaTableNotFound", "source_missing", False, None),
    ("ConcurrentModification", "transient", True, 5),
    ("LakehouseCapacityExceeded", "transient", True, None),
    ("Mashup evaluation error", "schema", False, None),
    ("Gateway timeout", "transient", True, None),
    ("Credential refresh failed", "auth", False, None),
    ("DWU limit exceeded", "infra", True, None),
    ("Login failed", "auth", False, None),
)

# Who does what for a category. (category, first action, second action, team)
ESCALATION = (
    ("transient", "Auto-rerun (3x)", "If all 3 fail", "L2"),
    ("auth", "Refresh + rerun", "If refresh fails", "L2"),
    ("infra", "Auto-rerun (3x)", "If all 3 fail", "L2"),
    ("schema", "Alert L2", "Update schema mapping", "L2"),
    ("permission", "Alert L2", "Grant RBAC permissions", "L2"),
    ("source_missing", "Alert L2", "Fix upstream pipeline", "Data Platform"),
    ("data_quality", "Alert DQ team", "Cleanse source data", "DQ"),
    ("unknown", "Alert L2", "Investigate", "L2"),
)

# Severity by category; INFO for the rest.
CRITICAL, WARNING = ("schema", "permission", "source_missing"), ("data_quality",)

# Retry budget, seconds to wait before each attempt, seconds within which a rerun is verified.
RETRY_BUDGET, BACKOFF_SECONDS, VERIFY_SECONDS = 3, (60, 300, 900), 100

# Targets in seconds for the first response, the automatic fix and the escalation.
RESPONSE_SECONDS, FIX_SECONDS, ESCALATION_SECONDS = 300, 900, 1800

#: Flat incident record. ``is_auto_fixable`` is read as text, since logs hold a boolean or a number there.
INCIDENT_LOG = (
    "timestamp STRING, pipeline_name STRING, pipeline_id STRING, run_id STRING, workspace_id STRING, error_category STRING, "
    "is_auto_fixable STRING, error_message STRING, root_cause STRING, action_taken STRING, success BOOLEAN, new_run_id STRING, "
    "rerun_succeeded BOOLEAN, retry_count INT, confidence_score DOUBLE, message STRING, _corrupt_record STRING"
)

#: Run record of a pipeline service.
RUN_RECORD = "id STRING, runId STRING, status STRING, startTimeUtc STRING, endTimeUtc STRING, failureReason STRING, errorMessage STRING, errorCode STRING"

#: Reply of a diagnosis service.
DIAGNOSIS = "error_category STRING, is_auto_fixable BOOLEAN, root_cause STRING, recommended_action STRING, confidence_score DOUBLE"

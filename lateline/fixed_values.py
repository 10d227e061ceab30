"""Word lists, lookup tables, thresholds, patterns and text formats.

Everything here has to hold exactly these values for results to be right, so it
is stated as plain text in its natural order. Operators take these as defaults.
"""

# ---- ticket features -------------------------------------------------------

PRIORITY_RANK = {"Highest": 5, "High": 4, "Medium": 3, "Low": 2, "Lowest": 1}
PRIORITY_RANK_OTHER = 3

ISSUE_TYPE_RISK = {
    "Bug": 0.7,
    "Story": 0.3,
    "Task": 0.2,
    "Epic": 0.5,
    "Sub-task": 0.1,
    "Spike": 0.4,
}
ISSUE_TYPE_RISK_OTHER = 0.3

STATUS_CATEGORY_CODE = {"To Do": 0, "In Progress": 1, "Done": 2}
STATUS_CATEGORY_CODE_OTHER = 0

BLOCKER_LINK_TYPES = ("blocks", "is blocked by")

SHORT_DESCRIPTION_WORDS = 10
LONG_DESCRIPTION_WORDS = 500
COMMENTS_PER_CHURN = 5
BUSY_COMMENT_COUNT = 10

# model inputs, in the order the model expects them
MODEL_FEATURES = (
    "story_points",
    "has_dependency",
    "dependency_count",
    "priority_numeric",
    "priority_interaction",
    "days_in_status",
    "days_since_created",
    "is_overdue",
    "description_ambiguity",
    "description_word_count",
    "sprint_rollover_count",
    "ticket_churn",
    "assignee_churn",
    "blocker_dependency_ratio",
    "issue_type_risk",
    "status_category_encoded",
    "complexity_per_person",
    "team_wip",
    "assignee_load",
    "avg_sentiment",
    "sentiment_velocity",
    "sentiment_anomaly",
    "comment_count",
)

# ---- model -----------------------------------------------------------------

RISK_HIGH = 0.7
RISK_MEDIUM = 0.4
TREE_DEPTH = 6
LEARNING_RATE = 0.1
BOOSTING_ROUNDS = 200
DEFAULT_POSITIVE_WEIGHT = 2.0
MODEL_SEED = 42
FOLDS = 5
TOP_FACTORS = 5

# ---- sentiment -------------------------------------------------------------

# engineering terms and their valence
ENGINEERING_LEXICON = {
    "blocked": -2.5,
    "blocker": -2.5,
    "regression": -2.0,
    "broken": -2.0,
    "outage": -3.0,
    "incident": -2.0,
    "hotfix": -1.5,
    "rollback": -1.5,
    "tech debt": -1.0,
    "workaround": -0.5,
    "hack": -1.0,
    "scope creep": -1.5,
    "shipped": 2.0,
    "deployed": 1.5,
    "merged": 1.0,
    "resolved": 2.0,
    "unblocked": 2.5,
    "milestone": 1.5,
    "on track": 2.0,
    "lgtm": 1.5,
    "approved": 1.5,
}

# a small general list of our own; callers pass a fuller one where they have it
GENERAL_LEXICON = {
    "good": 1.9,
    "great": 3.1,
    "excellent": 2.7,
    "happy": 2.7,
    "thanks": 1.9,
    "nice": 1.8,
    "love": 3.2,
    "win": 2.8,
    "bad": -2.5,
    "terrible": -2.1,
    "awful": -2.0,
    "angry": -2.3,
    "fail": -2.5,
    "failed": -2.3,
    "failing": -2.3,
    "error": -1.7,
    "problem": -1.7,
    "stuck": -1.0,
    "worried": -1.2,
    "delay": -1.3,
    "delayed": -0.9,
}

# rules of the published scoring model (Hutto and Gilbert, 2014)
SCORE_NORMALISER = 15
BOOST = 0.293
BOOST_BY_DISTANCE = (1.0, 0.95, 0.9)
NEGATION = -0.74
SHOUTED = 0.733
EXCLAMATION, EXCLAMATIONS_COUNTED = 0.292, 4
QUESTION, QUESTIONS_COUNTED, MANY_QUESTIONS = 0.18, 3, 0.96
BEFORE_BUT, AFTER_BUT = 0.5, 1.5

# short lists of our own for the rules
BOOSTERS = (
    "absolutely", "completely", "especially", "extremely", "fully", "greatly", "highly", "hugely",
    "incredibly", "more", "most", "particularly", "really", "so", "totally", "utterly", "very",
)
DAMPENERS = ("almost", "barely", "hardly", "less", "little", "marginally", "partly", "scarcely", "slightly", "somewhat")
NEGATIONS = (
    "aren't", "can't", "cannot", "couldn't", "didn't", "doesn't", "don't", "hadn't", "hasn't", "haven't", "isn't",
    "neither", "never", "none", "nor", "not", "nothing", "nowhere", "shouldn't", "wasn't", "weren't", "without",
    "won't", "wouldn't",
)

ANOMALY_SIGMAS = 2.0
ANOMALY_MIN_WINDOWS = 3
ANOMALY_TYPE = "negative_sentiment_drop"
ANOMALIES_KEPT = 5
OUTLOOK_WINDOWS = 7
OUTLOOK_BAND = 0.1
VELOCITY_ALARM = -0.3
SKIPPED_MESSAGE_SUBTYPES = ("channel_join", "channel_leave", "bot_message")

# ---- redaction -------------------------------------------------------------

TICKET_TEXT_FIELDS = ("summary", "description")
MESSAGE_TEXT_FIELDS = ("text",)
MAX_CHUNK_BYTES = 99_000

# what Unicode calls white space, as a character class body
WHITE_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# the same characters one by one
WHITE_SPACE_CHARACTERS = "".join(
    map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)

# (name, pattern, placeholder), applied in this order
SECRET_PATTERNS = (
    ("aws_access_key", r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])", "[AWS_ACCESS_KEY]"),
    (
        "assigned_secret",
        r"(?i)(?<![\p{L}\p{N}_])(?:api[_-]?key|token|secret|password)"
        rf"[{WHITE_SPACE}]*[:=][{WHITE_SPACE}]*['\"]?[A-Za-z0-9_\-]{{20,}}['\"]?",
        "[REDACTED_SECRET]",
    ),
    ("database_uri", rf"(?i)(?:postgres|mysql|mongodb|redis)://[^{WHITE_SPACE}]+", "[DATABASE_URI]"),
    (
        "private_key",
        # up to the first end line, without looking at any character twice
        r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----[^-]*+(?:-(?!----END (?:RSA |EC )?PRIVATE KEY-----)[^-]*+)*+"
        r"-----END (?:RSA |EC )?PRIVATE KEY-----",
        "[PRIVATE_KEY]",
    ),
)
# a bare 40-character secret; off unless asked for, since it also hits digests
AWS_SECRET_PATTERN = (
    "aws_secret_key",
    r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])",
    "[AWS_SECRET_KEY]",
)

# entity type -> placeholder; any other type becomes [TYPE]
ENTITY_PLACEHOLDERS = {
    "NAME": "[NAME]",
    "EMAIL": "[EMAIL]",
    "PHONE": "[PHONE]",
    "ADDRESS": "[ADDRESS]",
    "AGE": "[AGE]",
    "DATE_TIME": "[DATETIME]",
    "SSN": "[SSN]",
    "PASSPORT_NUMBER": "[PASSPORT]",
    "DRIVER_ID": "[DRIVER_ID]",
    "CREDIT_DEBIT_NUMBER": "[CARD_NUMBER]",
    "CREDIT_DEBIT_CVV": "[CVV]",
    "CREDIT_DEBIT_EXPIRY": "[CARD_EXPIRY]",
    "BANK_ACCOUNT_NUMBER": "[BANK_ACCOUNT]",
    "BANK_ROUTING": "[BANK_ROUTING]",
    "IP_ADDRESS": "[IP_ADDRESS]",
    "URL": "[URL]",
    "USERNAME": "[USERNAME]",
    "PASSWORD": "[PASSWORD]",
    "AWS_ACCESS_KEY": "[AWS_ACCESS_KEY]",
    "AWS_SECRET_KEY": "[AWS_SECRET_KEY]",
}

# (type, pattern); where two match at one place the earlier one wins
ENTITY_PATTERNS = (
    ("URL", r"https?://[^\s<>\"]+"),
    # parts bounded as addresses are, and no start inside a run of letters, so no text is slow or nests deep
    ("EMAIL", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,15}[A-Za-z]{2,63}"),
    ("CREDIT_DEBIT_NUMBER", r"(?<![0-9A-Za-z_])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9A-Za-z_])"),
    ("SSN", r"(?<![0-9A-Za-z_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_])"),
    ("IP_ADDRESS", r"(?<![0-9A-Za-z_])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z_])"),
    ("PHONE", r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z_])"),
)

# ---- keys ------------------------------------------------------------------

PROJECT_KEY_PATTERN = r"^[A-Z][A-Z0-9_]{1,19}$"
ISSUE_KEY_PATTERN = r"^[A-Z][A-Z0-9_]{1,19}-[0-9]{1,7}$"

# ---- data quality and drift ------------------------------------------------

QUALITY_RULES = {
    "story_points": {"type": "numeric", "min": 0, "max": 100, "completeness": 0.5},
    "issue_key": {"type": "string", "uniqueness": 1.0, "completeness": 1.0},
    "status": {
        "type": "categorical",
        "allowed_values": [
            "Open",
            "To Do",
            "In Progress",
            "In Review",
            "QA",
            "Done",
            "Closed",
            "Reopened",
            "Blocked",
        ],
        "completeness": 0.95,
    },
    "priority": {
        "type": "categorical",
        "allowed_values": ["Highest", "High", "Medium", "Low", "Lowest"],
        "completeness": 0.8,
    },
    "created": {"type": "datetime", "completeness": 1.0},
}
OFFENDERS_SHOWN = 10
DRIFT_THRESHOLD_PCT = 10.0
MIN_BASELINE_IQR = 0.01
QUALITY_ALERT = "DATA_QUALITY_VIOLATION"
DRIFT_ALERT = "MODEL_DRIFT_DETECTED"
ALERT_VIOLATIONS = 10

# ---- lake ------------------------------------------------------------------

BRONZE_RETENTION_DAYS = 30
DEFAULT_FEATURE_SET = "risk_features"
SENTIMENT_FEATURE_SET = "sentiment_timeseries"
FEEDBACK_TYPES = ("approved", "edited", "rejected")
DEFAULT_FEEDBACK_TYPE = "edited"
LOOKBACK_HOURS = 24

# ---- reports ---------------------------------------------------------------

DIGEST_TICKETS = 15
RADAR_SUMMARY_CHARS = 80
TABLE_SUMMARY_CHARS = 60
PROMPT_DESCRIPTION_CHARS = 500
NO_HIGH_RISK_TEXT = "No high-risk tickets identified this period."
NO_PREDICTIONS_TEXT = "No risk predictions available."
NO_SENTIMENT_TEXT = "No Slack sentiment data available for this period."
NO_CONTEXT_TEXT = "No additional context available."
MISSING_ANALYSIS = {"hypothesis": "LLM analysis unavailable", "severity": "unknown"}

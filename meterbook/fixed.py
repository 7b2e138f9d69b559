"""Fixed values.

Everything in this file is data that has to equal the published file formats
and report contracts for results to agree: schema names, label tables,
patterns, rates, thresholds.  No logic lives here.
"""

# --- schema names checked on read -------------------------------------------
PORTABLE_SCHEMA = "codex.portable.usage.v1"
EXPORT_SCHEMA = "codeburn.export.v2"
LEDGER_SCHEMA = "codex.lifecycle.ledger.v1"
EVENT_SCHEMA = "codex.lifecycle.event.v1"
ACCOUNT_SCHEMA = "codex.official.usage.v1"
ALIAS_SCHEMA = "codex.project.aliases.v1"

# --- ledger source names as stored in ledger files --------------------------
SOURCE_BASELINE = "ccSwitch"
SOURCE_INCREMENT = "codeburnIncrement"
SOURCES = (SOURCE_BASELINE, SOURCE_INCREMENT)
DEFAULT_PROVIDER = "codex"

# --- labels ------------------------------------------------------------------
UNATTRIBUTED = "历史未归属"
UNCLASSIFIED = "历史未归类"
UNKNOWN_SESSION = "historical-unknown"
UNKNOWN_PROJECT_FRAGMENT = "项目"
UNKNOWN_DEVICE_FRAGMENT = "未知设备"
# blank, or one of the unattributed labels alone or before a separator
UNSPECIFIC_PATTERN = r"^[\s\p{Z}\x{feff}]*(?:$|历史未归(?:属|类)(?:\s*·|[\s\p{Z}\x{feff}]*$))"

ACTIVITY_LABELS = {
    "coding": "Coding",
    "delegation": "Delegation",
    "exploration": "Exploration",
    "conversation": "Conversation",
    "feature": "Feature Dev",
    "brainstorming": "Brainstorming",
    "debugging": "Debugging",
    "testing": "Testing",
    "refactoring": "Refactoring",
    "git": "Git Ops",
}

MODEL_LABELS = {
    "gpt-5.6-sol": "gpt-5.6-sol",
    "gpt-5.5": "GPT-5.5",
    "gpt-5.6-luna": "gpt-5.6-luna",
    "gpt-5.6-terra": "gpt-5.6-terra",
    "gpt-5.4-mini": "GPT-5.4 Mini",
    "codex-auto-review": "Codex Auto Review",
}

CLIENT_LABELS = {
    "CODEX_DESKTOP_APP": "Desktop App",
    "CODEX_WORK_WEB": "Web",
    "CODEX_WEB": "Web",
    "CODEX_CLI": "CLI",
    "CODEX_EXEC": "Exec",
    "CODEX_IDE": "IDE Extension",
}
CLIENT_PREFIX = "CODEX_"

# --- project path rules ------------------------------------------------------
WORKTREE_PATTERN = r"(?:^|/)\.codex/worktrees/[^/]+/(.+)$"
WORKTREE_MARKER = ".codex/worktrees/"
SCRATCH_PATTERN = r"documents/codex/\d{4}/\d{2}/\d{2}(?:/|$)"
SCRATCH_LABEL = "Codex scratch"
SITES_FRAGMENT = "/sites/plugin/sites/"
SITES_LABEL = "sites-plugin"
NUMBERED_PROJECT_PATTERN = r"(?:^|/)project/(\d+)(?:$|/)"
INLINE_PROJECT_PATTERN = r"(?:^|/)(project\d+)(?:$|/)"
HOME_LABEL = "Home"
OTHER_LABEL = "Other"
GENERIC_SEGMENTS = ("chat", "new", "app", "src", "work")
UUID_TEXT = r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}"
UUID_REPLACEMENT = "private-id"
LABEL_SEPARATOR = " · "

# --- rollout files -----------------------------------------------------------
ROLLOUT_DIR_PATTERN = r"(?i)/(?:archived_sessions|sessions)/"
ROLLOUT_FILE_PATTERN = r"(?i)^rollout-.*\.jsonl$"
ROLLOUT_META_TYPE = "session_meta"

# --- portable file field lists -----------------------------------------------
PORTABLE_ROOT_FIELDS = ("schema", "generatedAt", "timezone", "synthetic", "records")
PORTABLE_RECORD_FIELDS = (
    "rowId", "row_id", "timestamp", "project", "session", "sessionId", "session_id",
    "model", "activity", "category", "inputTokens", "input_tokens", "outputTokens",
    "output_tokens", "cacheReadTokens", "cache_read_tokens", "cacheWriteTokens",
    "cache_write_tokens", "estimatedCostUsd", "estimated_cost_usd", "cost_usd", "calls",
)
PORTABLE_CSV_HEADERS = (
    "row_id", "timestamp", "project", "session", "session_id", "model", "activity",
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens",
    "estimated_cost_usd", "cost_usd", "calls",
)
PORTABLE_ALIASES = {
    "row_id": ("rowId", "row_id"),
    "timestamp": ("timestamp",),
    "project": ("project",),
    "session": ("session", "sessionId", "session_id"),
    "model": ("model",),
    "activity": ("activity", "category"),
    "input": ("inputTokens", "input_tokens"),
    "output": ("outputTokens", "output_tokens"),
    "cache_read": ("cacheReadTokens", "cache_read_tokens"),
    "cache_write": ("cacheWriteTokens", "cache_write_tokens"),
    "cost": ("estimatedCostUsd", "estimated_cost_usd", "cost_usd"),
    "calls": ("calls",),
}
FORBIDDEN_FIELD_PATTERN = (
    r"(?i)(?:prompt|message|content|source[_-]?code|email|account[_-]?id|host(?:name)?"
    r"|api[_-]?key|secret|password)"
)
LABEL_LIMITS = {"project": 80, "session": 100, "model": 100, "activity": 60, "row_id": 100, "timestamp": 60}
EMAIL_PATTERN = r"(?i)\b[^\s@]+@[^\s@]+\.[^\s@]+\b"
OPAQUE_ID_PATTERN = r"^(?:[0-9a-f]{24,}|[A-Za-z0-9_-]{48,})$"
PATH_OR_URL_PATTERN = r"(?i)^(?:file:|https?:|/|[A-Za-z]:[\\/])"
PROJECT_PATH_PATTERN = r"(?i)^(?:file:|https?:|/|[A-Za-z]:[\\/])|[\\/]"
OFFSET_PATTERN = r"(?:Z|[+-]\d{2}:?\d{2})$"
MAX_DATE_SPAN_DAYS = 366

# --- numbers -----------------------------------------------------------------
MAX_SAFE_INTEGER = 9007199254740991
JS_EPSILON = 2.220446049250313e-16

# --- near-time merge ---------------------------------------------------------
CANDIDATE_WINDOW_MS = 10_000
PAIR_WINDOW_MS = 1_500

# --- credits -----------------------------------------------------------------
RATE_CARD = (
    ("GPT-5.6 Sol", 125.0, 12.5, 750.0),
    ("GPT-5.6 Terra", 50.0, 5.0, 300.0),
    ("GPT-5.6 Luna", 5.0, 0.5, 30.0),
    ("GPT-5.5", 125.0, 12.5, 750.0),
    ("GPT-5.4", 62.5, 6.25, 375.0),
)
REFERENCE_MODEL = "GPT-5.6 Sol"

# --- analysis thresholds -----------------------------------------------------
PEAK_RATIO_NOTABLE = 2.0
TOP_SHARE_NOTABLE = 0.6
CACHE_SHARE_NOTABLE = 0.8
FULL_COVERAGE = 0.999999
FRESH_HOURS = 24.0
COST_VIEW_TOLERANCE = 0.1

# --- sensitive material ------------------------------------------------------
SENSITIVE_KEYS = (
    r"authorization|proxy-authorization|cookie|cookies|set-cookie|access[-_]?token"
    r"|refresh[-_]?token|id[-_]?token|session[-_]?token|api[-_]?key|apikey|password|secret"
    r"|email|account[-_]?id|user[-_]?id|workspace[-_]?id|organization[-_]?id|org[-_]?id"
)
CREDENTIAL_TEXT = (
    r"(?i)(?:authorization\s*[:=]|proxy-authorization\s*[:=]|set-cookie\s*[:=]"
    r"|bearer\s+[a-z0-9._~-]{12,}|(?:access|refresh|session)[-_]?token\s*[:=])"
)
SECRET_PATTERNS = (
    ("AWS access key", r"\bAKIA[A-Z0-9]{16}\b"),
    ("GitHub token", r"\bghp_[A-Za-z0-9]{20,}\b"),
    ("GitHub fine-grained token", r"\bgithub_pat_[A-Za-z0-9_]{20,}\b"),
    ("OpenAI or generic API key", r"\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("Google API key", r"\bAIza[A-Za-z0-9_-]{30,}\b"),
    ("Slack token", r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b"),
    ("GitLab token", r"\bglpat-[A-Za-z0-9_-]{20,}\b"),
    ("npm token", r"\bnpm_[A-Za-z0-9]{20,}\b"),
    ("private key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
)
SECRET_ASSIGNMENT = (
    r"(?i)[\"']?\b(api[_-]?key|access[_-]?key|aws[_-]?secret[_-]?access[_-]?key"
    r"|client[_-]?secret|secret|password|token)\b[\"']?\s*[:=]\s*"
    r"(?:\"([^\"\r\n]{12,})\"|'([^'\r\n]{12,})'|([^\s#;,]{12,}))"
)
PLACEHOLDER_WORDS = (
    "your", "example", "sample", "placeholder", "changeme", "replace", "dummy",
    "mock", "test", "fake", "todo", "xxx", "redacted",
)
PRIVATE_PATH_PATTERNS = (
    ("macOS home path", r"/Users/([A-Za-z0-9._-]+)"),
    ("Linux home path", r"/home/([A-Za-z0-9._-]+)"),
    ("Windows home path", r"[A-Za-z]:[\\/]Users[\\/]([A-Za-z0-9._-]+)"),
)
UUID_FINDING = "UUID-shaped private identifier"
UUID_PATTERN = r"(?i)\b[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\b"
SAFE_HOME_SEGMENTS = ("all users", "default", "default user", "public", "shared")
ABSOLUTE_PATH_PATTERN = r"(?i)(?:file://|(?:^|[\"'])/(?:Users|home)/|[A-Za-z]:\\\\)"
PSEUDONYM_PATTERN = r"^session-[0-9a-f]{12}$"
EVENT_ID_PATTERN = r"^[0-9a-f]{64}$"
CONTROL_PATTERN = r"\p{Cc}"
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")

# characters removed by trimming: the ECMAScript white space set
TRIM_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# --- fixed values: forms of a repository remote; fingerprints made elsewhere must be met exactly ---
REMOTE_URL = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://(?:[^@/?#]*@)?([^/?#]*))?([^?#]*)"
REMOTE_SCP = r"^(?:[^@/\s]+@)?([^:/\s]+):(.+)$"
REMOTE_USER = r"^[^@/]+@(?=[^/]+/)"
REMOTE_QUERY = r"[?#].*$"
REMOTE_SUFFIX = r"\.git$"
DRIVE_PATH = r"(?i)^[a-z]:/"
DEFAULT_PORTS = {"https": "443", "http": "80"}

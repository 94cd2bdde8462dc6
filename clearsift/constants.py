"""Fixed values that results depend on: texts, limits, patterns and formats."""

# --- fixed values: limits -------------------------------------------------
RRF_K = 60
CANDIDATE_MULTIPLIER = 5
DEFAULT_K = 10
MAX_K = 20
DEFAULT_LOG_LIMIT = 20
MAX_LOG_LIMIT = 50
MAX_ACCESS_LIMIT = 200
DEFAULT_ACCESS_LIMIT = 50
DEFAULT_VIOLATION_LIMIT = 20
DAILY_QUOTA = 10
MAX_CHUNK_CHARS = 900
CHUNK_OVERLAP = 150
ENCODE_BATCH = 64
EMBEDDING_DIM = 384
UNTRUSTED_MAX = 300
EVIDENCE_CODE_MAX = 40
EVIDENCE_TITLE_MAX = 120
EVIDENCE_TEXT_MAX = 1200
RECORD_HOST_MAX = 80
RECORD_TYPE_MAX = 40
QUERY_PREFIX = "query: "
PASSAGE_PREFIX = "passage: "

# --- fixed values: texts shown to users -----------------------------------
MASKED_QUERY = "(다른 방문자의 질의)"
LOG_SCOPE_NOTICE = "이 집계는 열람 권한이 있는 호스트의 기록만 셉니다."
OUTSIDE_CLAUSE = "조항 밖"
UNKNOWN_TIME = "시각 미상"
EVIDENCE_LABEL = "규정"
RECORD_LABEL = "기록"
NO_EVIDENCE = "관련된 조항을 찾지 못했다."
NO_RECORDS = "해당하는 기록을 찾지 못했다."
TRUNCATION_MARK = "…(잘림)"
BROKEN_TRUNCATION_MARK = "…(잘 림)"
TAIL_MARKER = "참고자료"

# --- fixed values: character classes --------------------------------------
# White space as text processing understands it: ASCII controls that separate,
# no-break and typographic spaces, line and paragraph separators.
SPACE_CHARS = (
    "\\t-\\r\\x1c-\\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = f"[{SPACE_CHARS}]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NOT_SPACE = f"[^{SPACE_CHARS}]"
PRIVATE_SPACE = "\uf020"
PRIVATE_USE = "[\ue000-\uf8ff]"
PRIVATE_REPLACEMENT = "·"
# Every character that reads as an angle bracket after compatibility folding.
ANGLE_BRACKETS = "\u003c\ufe64\uff1c\u003e\ufe65\uff1e"
ANGLE_REPLACEMENTS = "\u2039\u2039\u2039\u203a\u203a\u203a"

# --- fixed values: patterns -----------------------------------------------
CODE = r"\p{Nd}+\.\p{Nd}+\.\p{Nd}+"
TITLE = rf"{NOT_SPACE}[^\n]{{0,200}}"
MARKDOWN_CLAUSE = rf"(?dm)^##{SPACE}+({CODE}){SPACE}+({TITLE})$"
PAGED_CLAUSE = rf"(?dm)^[{SPACE_CHARS}&&[^\n]]*({CODE}){SPACE}+({TITLE})$"
FRONT_MATTER = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n"
CITATION = r"(\[\d+\.\d+\.\d+\]|\d+\.\d+\.\d+)"
LEXEME = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"
HANGUL_ASCII_TERM = r"[0-9A-Za-z가-힣]+(?:\.[0-9A-Za-z가-힣]+)*"
SYSLOG_LINE = (
    rf"(?d)^([A-Z][a-z]{{2}}){SPACE}+(\p{{Nd}}{{1,2}}){SPACE}+"
    rf"(\p{{Nd}}{{2}}:\p{{Nd}}{{2}}:\p{{Nd}}{{2}}){SPACE}+({NOT_SPACE}+){SPACE}+"
    rf"([A-Za-z0-9_\-]+)(?:\[(\p{{Nd}}+)\])?:{SPACE}*(.*)$"
)
# Ordered: the first pattern found in the message decides the event type.
EVENT_PATTERNS = [
    ("auth_failure", rf"(?d)Failed password for (?:invalid user )?({NOT_SPACE}+)"),
    ("auth_failure", rf"(?d)authentication failure.*user=({NOT_SPACE}+)"),
    ("session_open", rf"(?d)Accepted {NOT_SPACE}+ for ({NOT_SPACE}+)"),
    ("session_open", rf"(?d)session opened for user ({NOT_SPACE}+)"),
    ("session_close", rf"(?d)session closed for user ({NOT_SPACE}+)"),
    ("privilege_use", rf"(?d)^{SPACE}*({NOT_SPACE}+){SPACE}*:{SPACE}*TTY="),
    ("access_denied", rf"(?d)(?:Permission denied|access denied).*user ({NOT_SPACE}+)"),
]
DEFAULT_EVENT_TYPE = "other"
EVENT_TYPES = [
    "auth_failure",
    "session_open",
    "session_close",
    "privilege_use",
    "access_denied",
    "other",
]

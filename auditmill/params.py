"""Operator parameters and lookup tables.

Every table here is a default; each operator takes its table as an argument, so a
new language or keyword is a changed argument and not a changed operator.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: they decide results and must stay as they are. -------------------

EXTENSION_LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
}

SUPPORTED_LANGUAGES = ("python", "javascript", "typescript", "java", "go", "c", "cpp")

EXCLUDED_DIRECTORIES = (
    "node_modules", ".venv", "venv", ".git", "__pycache__", "dist", "build", ".tox",
    ".mypy_cache", ".ruff_cache", "target",
)

MAX_FILE_BYTES = 1_048_576
MAX_CHUNK_LINES = 200

# Language names of the weakness catalogue.
CATALOGUE_LANGUAGES = {
    "python": "python",
    "javascript": "javascript",
    "typescript": "typescript",
    "java": "java",
    "go": "go",
    "c": "c",
    "c++": "cpp",
    "c#": "csharp",
    "php": "php",
    "ruby": "ruby",
    "rust": "rust",
    "swift": "swift",
    "kotlin": "kotlin",
}
CATALOGUE_DEFAULT_LANGUAGES = ("python", "java", "javascript", "go", "c", "cpp")
CATALOGUE_RETIRED = ("Deprecated", "Obsolete")

# Language names of the rule corpus; names without an entry are dropped.
RULE_LANGUAGES = {
    "python": "python",
    "javascript": "javascript",
    "typescript": "typescript",
    "java": "java",
    "go": "go",
    "c": "c",
    "cpp": "cpp",
    "c++": "cpp",
}

SEVERITIES = ("critical", "high", "medium", "low", "info")

# Tiers are tried in order and the first one with a hit wins.
SEVERITY_KEYWORDS = (
    ("critical", ("remote code execution", "arbitrary code", "privilege escalation",
                  "authentication bypass", "sql injection", "command injection")),
    ("high", ("cross-site scripting", "path traversal", "xml injection", "deserialization",
              "buffer overflow", "use after free", "format string", "integer overflow")),
    ("medium", ("information disclosure", "denial of service", "cross-site request",
                "open redirect", "session fixation")),
)
SEVERITY_DEFAULT = "low"

# Keywords in a guide's file name; tried in order, so an earlier entry hides a later one.
GUIDE_WEAKNESSES = (
    ("sql_injection", "CWE-89"),
    ("sqli", "CWE-89"),
    ("injection", "CWE-89"),
    ("xss", "CWE-79"),
    ("cross_site_scripting", "CWE-79"),
    ("path_traversal", "CWE-22"),
    ("directory_traversal", "CWE-22"),
    ("csrf", "CWE-352"),
    ("cross_site_request", "CWE-352"),
    ("xxe", "CWE-611"),
    ("xml_external", "CWE-611"),
    ("deserialization", "CWE-502"),
    ("authentication", "CWE-287"),
    ("session_management", "CWE-384"),
    ("access_control", "CWE-284"),
    ("cryptograph", "CWE-327"),
    ("password_storage", "CWE-916"),
    ("input_validation", "CWE-20"),
    ("open_redirect", "CWE-601"),
    ("ssrf", "CWE-918"),
    ("command_injection", "CWE-77"),
    ("ldap_injection", "CWE-90"),
    ("xpath_injection", "CWE-643"),
    ("clickjacking", "CWE-1021"),
    ("http_headers", "CWE-116"),
    ("logging", "CWE-532"),
    ("file_upload", "CWE-434"),
    ("insecure_direct", "CWE-639"),
    ("mass_assignment", "CWE-915"),
    ("prototype_pollution", "CWE-1321"),
)

# Words that show a language is talked about. "+" is no word character, so "c++" counts only
# where a word character follows, as in "C++11"; otherwise it is read as "c".
LANGUAGE_WORDS = (
    ("python", (r"python",)),
    ("javascript", (r"javascript", r"node\.?js", r"js")),
    ("typescript", (r"typescript", r"ts")),
    ("java", (r"java",)),
    ("go", (r"golang", r"go")),
    ("cpp", (r"c\+\+", r"cpp")),
    ("c", (r"c",)),
    ("php", (r"php",)),
    ("ruby", (r"ruby", r"rails")),
)

SEVERITY_ICONS = {
    "critical": "🔴",
    "high": "🟠",
    "medium": "🟡",
    "low": "🔵",
    "info": "⚪",
}

# Fence language of a report; note that ".cjs" has none.
FENCE_LANGUAGES = {ext: lang for ext, lang in EXTENSION_LANGUAGES.items() if ext != ".cjs"}
FENCE_DEFAULT = "text"


@dataclass(frozen=True)
class TextLimits:
    """Lengths at which texts and lists are cut."""

    chunk_text: int = 2000
    title: int = 200
    catalogue_details: int = 600
    catalogue_mitigation: int = 300
    catalogue_mitigations: int = 3
    catalogue_mitigation_text: int = 400
    catalogue_example: int = 500
    catalogue_examples: int = 3
    section_minimum: int = 50
    rule_message: int = 600
    rule_pattern: int = 400
    rule_pattern_items: int = 3
    prompt_body: int = 800
    prompt_examples: int = 2
    table_title: int = 30


@dataclass(frozen=True)
class ReportLabels:
    """Fixed words of the written report. The first line is the caller's."""

    heading: str = "Отчёт об анализе"
    empty: str = "✓ **Результат:** Уязвимостей не обнаружено."
    total: str = "**Найдено уязвимостей:** "
    distribution: str = "**Распределение:** "
    lines: str = "**Строки:** "
    confidence: str = "**Уверенность:** "
    severity: str = "**Severity:** "
    description: str = "**Описание:** "
    recommendation: str = "**Рекомендация:** "
    made: str = ""    # a line below the heading, as the time of the run; none if empty
    footer: str = ""  # the last lines; none if empty


# --- End of fixed values. ----------------------------------------------------------


@dataclass(frozen=True)
class AuditParams:
    """Settings of a whole audit run."""

    top_k: int = 5
    min_confidence: float = 0.5
    max_chunk_lines: int = MAX_CHUNK_LINES
    embedding_dim: int = 768
    embed_batch: int = 32
    languages: tuple[str, ...] = SUPPORTED_LANGUAGES
    language_mode: str = "post"
    empty_means_all: bool = False
    attempts: int = 2
    limits: TextLimits = TextLimits()


SYSTEM_PROMPT = (
    "You review one piece of source code for security weaknesses. Use the reference notes "
    "given with it and cite only weakness ids that occur there. Report only what you are sure "
    "of and give line numbers as printed. Reply with one JSON object "
    '{"findings": [{"cwe_id", "severity", "title", "description", "line_start", "line_end", '
    '"recommendation", "confidence"}]} and nothing else; the list is empty if there is nothing '
    "to report."
)

USER_PROMPT = (
    "Reference notes:\n\n{knowledge}\n\n"
    "Source ({language}), file {file_path}, scope {name}:\n\n"
    "```{language}\n{code}\n```\n"
)

"""Fixed values that results depend on: character classes, patterns, word lists and ranks.  All are data formats."""

# Character classes (Java and RE2 syntax).
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
BROAD = (
    r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{3000}-\x{303F}"
    r"\x{FF00}-\x{FFEF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]"
)

HAN_CHARS = "[\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF]"  # the same as HAN in Python's syntax

# Patterns of tokens that a translation must leave alone.
PROTECTED = (
    r"```[\s\S]*?```"
    r"|`[^`\n]+`"
    r"|</?[A-Za-z][^>]*>"
    r"|\|\|\|SEP\|\|\|"
    r"|https?://[^\s)>'\"]+"
    r"|\((?:[#./][^)\s]+|[^)\s]+\.[A-Za-z0-9]{1,8}(?:#[^)\s]+)?)\)"
    r"|\\(?:[\\'\"abfnrtv]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"
    r"|\{\{[^{}]+\}\}"
    r"|\$\{[A-Za-z_][A-Za-z0-9_]*\}"
    r"|\$[A-Za-z_][A-Za-z0-9_]*(?:_[A-Za-z0-9]+)*"
    r"|%\([^)]+\)[sd]|%[sd]"
    r"|\{[A-Za-z_][A-Za-z0-9_]*\}"
)
URL = r"https?://[^\s)>'\"]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PLACEHOLDER = r"\{\{[^{}]+\}\}|\{[A-Za-z_][A-Za-z0-9_]*\}|%\([^)]+\)[sd]|%[sd]|\$\{[A-Za-z_][A-Za-z0-9_]*\}|\$[A-Za-z_][A-Za-z0-9_]*"
CODE_BLOCK = r"(?s)```[^\n]*\n(.*?)```"
INLINE_CODE = r"`([^`\n]+)`"
LINK_LABEL = r"\[([^\]]+)\]\([^)]*\)"
MARKDOWN_PREFIX = r"^(\s*(?:#{1,6}\s+|>\s+|[-*+]\s+(?:\[[ xX]\]\s+)?|\d+[.)]\s+)?)"
TABLE_RULE = r"^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*$"
ENUM_LIKE = r"^[A-Za-z0-9_.\-]+$"

JSON_QUOTED = '"([^"]+)"'
JSON_NAME = "^[a-zA-Z_][a-zA-Z0-9_.-]*$"
COMMENT_BLOCK = r"(?ms)^/\*.*?(?:^(?!#(?!!)|//|/\*)[^\n]*?\*/[^\n]*$|\z)"

# Span kinds, severities and penalties.
KINDS = [
    "comment", "docstring", "string", "template_string", "template_string_fragment", "jsx_text", "ui_attribute", "json_value", "yaml_value",
    "toml_value", "markdown_heading", "markdown_paragraph", "markdown_table_cell", "markdown_link_label", "html_text", "line_comment",
    "block_comment", "doc_comment",
]
UI_ATTRIBUTES = ["title", "alt", "aria-label", "placeholder"]
ROUTE_CALLS = ["fetch", "navigate", "push", "replace", "route", "redirect"]
SEVERITY = {"info": 1, "warning": 2, "error": 3}
PENALTY = {"error": 5.0, "warning": 2.0, "info": 0.5}

# Which files are read.
MARKDOWN_SUFFIXES = [".md", ".markdown"]
TAGGED_SUFFIXES = [".html", ".htm", ".jinja2", ".vue", ".jsx", ".tsx", ".ui", ".qml", ".xml"]
DOCUMENT_SUFFIXES = [".md", ".markdown", ".rst", ".txt"]
TEXT_SUFFIXES = [
    ".md", ".markdown", ".rst", ".txt", ".adoc", ".py", ".rs", ".js", ".ts", ".jsx", ".tsx", ".go", ".java", ".c", ".cpp", ".h",
    ".hpp", ".cs", ".rb", ".php", ".swift", ".kt", ".scala", ".lua", ".sh", ".bash", ".zsh", ".fish", ".r", ".m", ".mm", ".pl",
    ".pm", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".vue", ".svelte", ".jinja", ".jinja2", ".j2", ".ejs", ".hbs",
    ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".properties", ".env", ".xml", ".svg", ".proto", ".graphql",
    ".gql", ".ui", ".qml", ".po", ".pot",
]
BINARY_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".avif", ".mp3", ".mp4", ".wav", ".ogg", ".flac", ".aac", ".avi",
    ".mov", ".mkv", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z",
    ".rar", ".exe", ".dll", ".so", ".dylib", ".a", ".lib", ".o", ".obj", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".sqlite",
    ".db", ".bin", ".dat", ".pyc", ".pyo", ".class", ".jar", ".war", ".mo",
]
SKIPPED_FOLDERS = [
    "node_modules", ".git", "__pycache__", ".pytest_cache", "target", "build", "dist", ".next", ".nuxt", "vendor", "venv",
    ".venv", "env", ".env", ".tox", ".mypy_cache", ".ruff_cache", "coverage", ".nyc_output", ".gradle", ".maven",
]
VERIFY_SKIPPED_FOLDERS = [
    ".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", ".pytest_cache", ".ruff_cache", "node_modules", "dist",
    "build",
]
LOCK_FILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Pipfile.lock", "composer.lock",
    "Gemfile.lock", "go.sum", "bun.lockb",
]
MAX_FILE_BYTES = 500_000
STATE_FILE = ".lexloom-state"
SYNTAX_SUFFIXES = [".json", ".yaml", ".yml", ".toml", ".py", ".xml", ".svg", ".ui"]

FILES_DDL = "path string, content binary, length long, is_symlink boolean, link_target string, snapshot string"
SEGMENT_DDL = (
    "id string, path string, kind string, start_byte long, end_byte long, line int, `column` int, source_text string, target_text string, "
    "file_sha256 string, source_sha256 string, translation_key string, context_before string, context_after string, "
    "protected_context array<string>"
)

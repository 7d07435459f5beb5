"""Fixed values that results depend on: names, patterns, limits and texts, stated as they must be."""

# File names and kinds.
TEXT_EXTENSIONS = [".md", ".txt", ".rst", ".yaml", ".yml", ".toml", ".json", ".html", ".htm", ".css"]
SCRIPT_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx"]
PYTHON_EXTENSION = ".py"
KNOWN_FILENAMES = ["dockerfile"]
EXCLUDED = [
    "__pycache__/*", ".git/*", "venv/*", ".*/", ".*", "*.log", "*.tmp", "*.bak",
    "*.swp", "*.pyc", "*.pyo", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "*.min.js", "*.min.css",
]
KIND_BY_EXTENSION = {
    ".md": "MARKDOWN_FILE", ".rst": "TEXT_FILE", ".txt": "TEXT_FILE", ".yaml": "YAML_FILE", ".yml": "YAML_FILE",
    ".toml": "TOML_FILE", ".json": "JSON_FILE", ".html": "HTML_FILE", ".htm": "HTML_FILE", ".css": "CSS_FILE",
}
KIND_BY_FILENAME = {"dockerfile": "DOCKERFILE"}
CONFIG_KINDS = ["MARKDOWN_FILE", "TEXT_FILE", "YAML_FILE", "TOML_FILE", "DOCKERFILE", "JSON_FILE", "HTML_FILE", "CSS_FILE"]
NODE_TYPES = [
    "FOLDER", "FILE", "IMPORT_BLOCK", "CLASS", "FUNCTION", "NON_FUNCTION_NON_CLASS", "REACT_COMPONENT", "REACT_HOOK", *CONFIG_KINDS,
]
EDGE_TYPES = ["CONTAINS", "IS_PART_OF", "DEFINED_IN", "METHOD_OF", "CALLS", "IMPORTS", "INHERITS_FROM", "USES_IMPORT", "REFERENCES", "RENDERS"]

# Content.
CONTENT_LIMIT = 6_000
CONTENT_LIMITS = {"CSS_FILE": 10_000, "HTML_FILE": 10_000}
EMPTY_FILE = "[This file is empty — no content to document.]"
JSON_KEYS, JSON_ITEMS, JSON_STRING, JSON_ITEM_CHARS = 30, 5, 80, 120

# Summaries.
FAILED_PREFIXES = ["(Summary generation failed", "(Error"]
FAILED_SUMMARY = "(Summary generation failed)"
EMPTY_FILE_SUMMARY = "This file is empty. There is no content to document."
EMPTY_PYTHON_SUMMARY = "This Python file is empty or contains only comments. There is no code to document."
EMPTY_FOLDER_SUMMARY = "This folder is empty."
NO_ROOTS = "# Documentation Assembly Failed: No Root Nodes Found"

# Documents.
KIND_LABELS = {
    "MARKDOWN_FILE": "Markdown", "TEXT_FILE": "Text File", "YAML_FILE": "YAML Config", "TOML_FILE": "TOML Config",
    "DOCKERFILE": "Dockerfile", "JSON_FILE": "JSON", "HTML_FILE": "HTML", "CSS_FILE": "CSS",
}
KIND_LANGUAGES = {
    "MARKDOWN_FILE": "markdown", "TEXT_FILE": "", "YAML_FILE": "yaml", "TOML_FILE": "toml",
    "DOCKERFILE": "dockerfile", "JSON_FILE": "json", "HTML_FILE": "html", "CSS_FILE": "css",
}

# Resolution.
MODULE_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
BARE_ALIASES = ["components", "utils", "lib"]

# Tasks and calls.
TASK_TTL_SECONDS = 3600
BACKOFF_START, BACKOFF_LIMIT, RETRIES = 10, 100, 10
RATE_LIMIT_DEFAULT, RATE_LIMIT_BUFFER = 60.0, 0.5

"""Fixed values of the data model."""

from __future__ import annotations

#: Node types.
NODE_TYPES = ("file", "function", "class", "module", "concept", "config", "document", "service", "table", "endpoint", "pipeline", "schema", "resource", "fault", "fix", "pattern")

#: How a fault travels along an edge type. Named sides are those it can start from.
RULES = {
    "target": ("calls", "imports", "inherits", "implements", "exports", "subscribes", "writes_to", "depends_on", "provisions"),
    "source": ("contains", "publishes", "middleware", "reads_from", "transforms", "validates", "configures", "deploys", "serves", "triggers", "documents", "routes", "defines_schema"),
    "both": ("related", "similar_to", "migrates", "relates_to_fault"),
    "none": ("tested_by", "fixes", "mitigates", "suggests", "learned_from"),
}

#: Ordered import extensions.
IMPORT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".java")
#: Source extensions, ignored directories (the last holds an engine's own state) and files of a scan.
SOURCE_EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".java", ".go", ".rs", ".rb", ".php", ".cpp", ".c", ".h", ".hpp", ".cs", ".swift", ".kt",
    ".scala", ".sh", ".bash",
)
IGNORED_DIRS = (
    "node_modules", ".git", "dist", "build", "out", "coverage", ".nyc_output", ".cache", ".tmp", "vendor", ".venv", "venv", "__pycache__",
    ".corpusloom",
)
IGNORED_FILES = (
    ".DS_Store", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock",
)

#: Stop words of the plan cache, of recommendations and of cluster names.
PLAN_STOP = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "this", "that", "with", "from", "have", "has",
    "been", "will", "would", "should", "could", "fix", "add", "remove", "update", "change", "into", "than", "only", "some", "time", "very",
)
RECOMMEND_STOP = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "fix", "add", "remove", "update", "change",
    "this", "that", "with", "from", "have", "has", "been",
)
CLUSTER_STOP = (
    "the", "and", "for", "with", "this", "that", "from", "into", "class", "function", "const", "return", "export", "import", "extends", "implements",
    "methods", "props", "calls", "void", "string", "number", "boolean",
)

#: Characters a token by model name, first prefix that fits; the rest 4.0.
CHARS_PER_TOKEN = (
    ("glm-5.1", 2.5), ("glm-", 2.6), ("kimi-k2.5", 2.6), ("kimi-k2.6", 2.6), ("kimi-", 2.7), ("deepseek", 2.8), ("gpt-5.5", 3.4), ("gpt-5.4", 3.5),
    ("gpt-5", 3.6), ("gpt-4.5", 4.0), ("gpt-4o", 4.2), ("gpt-4", 4.0), ("gpt-3.5", 4.2), ("claude-", 3.8),
)
#: Share of the budget at which a level begins, and what it allows.
LEVELS = ((0.95, "prompt_user"), (0.90, "core_only"), (0.80, "disable_search"), (0.70, "reduce_depth"))
#: How far a source is believed; the rest .60.
CREDIBILITY = {"stackoverflow": 0.95, "mdn": 0.95, "react-docs": 0.92, "typescriptlang": 0.90, "github": 0.88, "javascript.info": 0.85, "dev.to": 0.75, "medium": 0.70}


def rule_rows() -> list[tuple[str, bool, bool]]:
    """(type, from_source, from_target) of every edge type."""
    return [(t, side in ("source", "both"), side in ("target", "both")) for side, types in RULES.items() for t in types]

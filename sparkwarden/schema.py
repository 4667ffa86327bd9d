"""Record shapes shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The enumerations a finding may use.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
FINDING_TYPES = [
    "hallucinated_package",
    "hardcoded_secret",
    "insecure_config",
    "ai_pattern_error",
    "sql_injection",
    "xss",
    "ssrf",
    "path_traversal",
    "insecure_deserialization",
    "command_injection",
    "open_redirect",
    "information_leakage",
    "missing_security_measure",
    "other",
]
LAYERS = ["L1", "L2", "L3"]
REGISTRIES = ["npm", "pypi", "cargo", "gomod", "maven"]

EDIT = "struct<startLine:int,startColumn:int,endLine:int,endColumn:int,newText:string>"
FIX = f"struct<description:string,edits:array<{EDIT}>>"

# Column name -> type of the finding record.
FINDING = {
    "id": "string",
    "type": "string",
    "severity": "string",
    "message": "string",
    "file": "string",
    "line": "int",
    "column": "int",
    "end_line": "int",
    "end_column": "int",
    "evidence": "string",
    "suggestion": "string",
    "fix": FIX,
    "alternative_fixes": f"array<{FIX}>",
    "detection_layer": "string",
    "detection_rule": "string",
    "timestamp": "bigint",
    "dismissed": "boolean",
    "dismissed_reason": "string",
}
FINDING_COLUMNS = list(FINDING)
FINDING_DDL = ", ".join(f"`{name}` {kind}" for name, kind in FINDING.items())

SCAN_RUN_DDL = (
    "scan_id string, started_at bigint, completed_at bigint, project string, cwd string, "
    "target_paths array<string>, file_count int"
)
REFERENCE_COLUMNS = [
    "file",
    "registry",
    "package_name",
    "lookup",
    "raw_specifier",
    "line",
    "column",
    "end_line",
    "end_column",
    "source",
]


def severity_rank(severity: Column) -> Column:
    """0 for critical up to 4 for info; null for an unknown name."""
    rank = F.create_map(*[F.lit(x) for pair in ((s, i) for i, s in enumerate(SEVERITIES)) for x in pair])
    return F.try_element_at(rank, severity)

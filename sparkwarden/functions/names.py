"""Package-name normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modules that ship with each platform.
NODE_BUILTINS = [
    "assert", "buffer", "child_process", "cluster", "crypto", "dns", "events", "fs", "http", "https", "net", "os",
    "path", "process", "querystring", "readline", "stream", "string_decoder", "tls", "tty", "url", "util", "vm", "zlib",
]
PYTHON_STDLIB = [
    "abc", "argparse", "asyncio", "base64", "collections", "contextlib", "csv", "dataclasses", "datetime", "decimal",
    "functools", "hashlib", "http", "importlib", "io", "itertools", "json", "logging", "math", "multiprocessing", "os",
    "pathlib", "pickle", "random", "re", "secrets", "shlex", "shutil", "sqlite3", "statistics", "string", "subprocess",
    "sys", "tempfile", "time", "typing", "urllib", "uuid", "xml",
]
RUST_STDLIB = ["alloc", "core", "crate", "self", "std", "super"]
PYTHON_ALIASES = {
    "PIL": "pillow",
    "cv2": "opencv-python",
    "sklearn": "scikit-learn",
    "dotenv": "python-dotenv",
    "yaml": "pyyaml",
}


def index_key(name: Column) -> Column:
    """Key under which the package index and the resolution cache store a name."""
    return F.regexp_replace(F.lower(F.trim(name)), "_", "-")


def seed_key(registry: Column, name: Column) -> Column:
    lowered = F.lower(F.trim(name))
    return F.when(registry == "cargo", F.regexp_replace(lowered, "[-_]", "-")).otherwise(lowered)


def npm_package(specifier: Column) -> Column:
    """Package part of an import specifier; null for relative, internal and built-in modules."""
    bare = F.regexp_replace(specifier, r"^!+", "")
    parts = F.split(bare, "/", -1)
    name = F.when(
        bare.startswith("@"), F.concat(parts[0], F.lit("/"), F.coalesce(F.get(parts, 1), F.lit("")))
    ).otherwise(parts[0])
    outside = specifier.rlike(r"^(?:[./#]|node:)") | (specifier == "")
    return F.when(~outside & (name != "") & ~name.isin(NODE_BUILTINS), name)


def pypi_package(raw: Column) -> Column:
    name = index_key(raw)
    return F.when((name != "") & ~name.isin(PYTHON_STDLIB), name)


def python_module(raw: Column) -> Column:
    """Distribution name for an imported module path."""
    first = F.substring_index(F.trim(raw), ".", 1)
    alias = F.create_map(*[F.lit(x) for pair in PYTHON_ALIASES.items() for x in pair])
    named = F.coalesce(F.try_element_at(alias, first), first)
    return F.when((first != "") & ~first.isin(PYTHON_STDLIB), pypi_package(named))


def rust_crate(raw: Column) -> Column:
    name = F.trim(raw)
    return F.when((name != "") & ~name.isin(RUST_STDLIB), name)


def go_module(raw: Column, infer_root: bool) -> Column:
    """Module path; for imports cut to the root: three parts on code forges and x-repositories, else two."""
    path = F.trim(raw)
    parts = F.split(path, "/", -1)
    valid = (path != "") & ~path.startswith(".") & parts[0].contains(".")
    if not infer_root:
        return F.when(valid, path)
    deep = parts[0].isin("github.com", "gitlab.com", "bitbucket.org") | (
        parts[0].isin("golang.org", "google.golang.org") & (F.get(parts, 1) == "x")
    )
    depth = F.when(F.coalesce(deep, F.lit(False)), F.lit(3)).otherwise(F.lit(2))
    return F.when(valid, F.when(F.size(parts) >= depth, F.array_join(F.slice(parts, F.lit(1), depth), "/")).otherwise(path))


def maven_coordinate(group: Column, artifact: Column) -> Column:
    return F.concat(F.trim(group), F.lit(":"), F.trim(artifact))

"""Path globs of suppression rules, translated once per rule on the driver."""

from __future__ import annotations


def glob_regex(glob: str) -> str:
    """Case-insensitive regular expression for a path glob with ``**``, ``*``, ``?``, ``[..]`` and ``{a,b}``.

    A glob without a slash matches the last path segment, as path-matching libraries do for base names.
    """
    out, i, depth = [], 0, 0
    while i < len(glob):
        rest = glob[i:]
        if rest.startswith("**/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if rest == "**":
            out.append(".*")
            i += 2
            continue
        c = glob[i]
        close = glob.find("]", i + 2)
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and close > 0:
            body = glob[i + 1 : close]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = close
        elif c == "{" and "}" in rest and "," in rest[: rest.index("}")]:
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append("\\" + c if not (c.isalnum() or c in "_/ ") else c)
        i += 1
    body = "".join(out)
    return f"(?i)(?:.*/)?{body}" if "/" not in glob else f"(?i){body}"

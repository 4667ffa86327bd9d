"""Text that must not stop a scan or hide from it."""

import pytest

from sparkwarden.operators.detect import scan_catalogue
from sparkwarden.operators.references import extract_references


@pytest.mark.parametrize("name", ["a\\E(", "\\Q[", "(", "x\"y", "$1\\", "a\\E\\Q*"])
def test_package_names_are_text_not_patterns(spark, name):
    import json

    body = json.dumps({"dependencies": {name: "1", "left-pad": "2"}})
    rows = extract_references(spark.createDataFrame([("package.json", body, "json")], "file string, text string, language string")).collect()
    assert {r["package_name"] for r in rows} == {name, "left-pad"}


@pytest.mark.parametrize("space", [" ", "\t", "\u00a0", "\u2003", "\u3000", "\ufeff", "\u2028"])
def test_unicode_spaces_do_not_hide_matches(spark, space):
    text = f"DEBUG{space}={space}True\nel.innerHTML{space}={space}value\n"
    found = scan_catalogue(spark.createDataFrame([("a.py", text, "python")], "file string, text string, language string"), 0)
    plain = scan_catalogue(spark.createDataFrame([("a.py", text.replace(space, " "), "python")], "file string, text string, language string"), 0)
    rules = lambda df: sorted(r["detection_rule"] for r in df.collect())
    assert rules(found) == rules(plain) and len(rules(plain)) >= 1


def test_patterns_keep_classes_and_escapes():
    from sparkwarden.functions.text import java_regex

    assert java_regex(r"\\s\[\s]") == r"\\s\[[" + java_regex(r"\s")[1:-1] + "]]"
    assert java_regex(r"[^\S\n]") == r"[^\S\n]"
    assert java_regex(r"\bx", "i").startswith("(?i)(?:")

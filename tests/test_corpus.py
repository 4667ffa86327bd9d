"""Reading file trees."""

from sparkwarden.sources.corpus import read_corpus


def test_names_and_folders_decide(spark, tmp_path):
    texts = {
        "a.py": "x = 1", "src/B.TS": "let y", "src/deep/Dockerfile": "FROM x", "docs/readme.md": "no", "img.png": "\x89PNG",
        "node_modules/m/index.js": "no", "src/.git/x.txt": "no", "out/x.py": "no", "layout/x.yml": "a: é", "requirements.txt": "flask", "py": "no",
    }
    for name, text in texts.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    found = {r["file"]: r["text"] for r in read_corpus(spark, str(tmp_path)).collect()}
    assert found == {n: texts[n] for n in ("a.py", "src/B.TS", "src/deep/Dockerfile", "layout/x.yml", "requirements.txt")}

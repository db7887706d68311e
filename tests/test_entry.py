import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def names(folder: Path) -> set[str]:
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout
    queries, oracles = (set(line.split()) for line in out.splitlines())
    assert oracles <= queries
    return queries


def test_works_without_the_corpus_part(tmp_path):
    shutil.copytree(REPO / "sparkfield", tmp_path / "sparkfield", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    assert names(tmp_path) == {n for n in names(REPO) if not n.startswith("op") and n != "pipeline"}


def test_smoke(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["block", "nbits"]

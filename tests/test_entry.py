import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows_and_oracles_have_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_subpackage(tmp_path):
    for p in ROOT.iterdir():
        if p.name in ("corpus_pipeline.py", ".git", "tests", "quarry"):
            continue
        (tmp_path / p.name).symlink_to(p)
    (tmp_path / "quarry").mkdir()
    for p in (ROOT / "quarry").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "quarry" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_library_does_not_import_the_subpackage():
    for p in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "quarry").parts:
            assert "quarry.llm" not in p.read_text(), p

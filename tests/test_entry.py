import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_oracles_belong_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_without_optional_part(tmp_path):
    """The rest imports and has its queries when the training-data operators are gone."""
    for p in ("__spark_entry__.py", "episodeframe"):
        source = ROOT / p
        if source.is_dir():
            shutil.copytree(source, tmp_path / p, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'summarize_by_model' in q and not any(n.startswith('op') or n == 'pipeline' for n in q if n != 'optimality_gap'), sorted(q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_imports_the_optional_part():
    for p in (ROOT / "episodeframe").rglob("*.py"):
        if "llm" not in p.parts:
            assert "episodeframe.llm" not in p.read_text(), p

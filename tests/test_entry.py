import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_imports_without_a_session_or_the_optional_parts(tmp_path):
    import shutil

    shutil.copytree(ROOT / "featlake", tmp_path / "featlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op1_') for n in q) and e.oracle_sql(); print(len(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert run.returncode == 0, run.stderr


def test_a_missing_library_costs_the_optional_queries_only(tmp_path):
    import shutil

    shutil.copytree(ROOT / "featlake", tmp_path / "featlake", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    (tmp_path / "xxhash.py").write_text("raise ImportError('no such library')")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'op3_near_dedup' not in q and 'pipeline' not in q and e.oracle_sql()"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert run.returncode == 0, run.stderr

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


def test_entry_imports_without_a_session_and_sql_belongs_to_queries():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q); print(len(q), len(o))"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize("pipeline", [False, True])
def test_the_library_stands_without_the_training_data_operators(tmp_path, pipeline):
    (tmp_path / "wardstone").mkdir()
    for p in (REPO / "wardstone").iterdir():
        if p.name != "llm":
            (tmp_path / "wardstone" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(REPO / "__spark_entry__.py")
    if pipeline and (REPO / "corpus_pipeline.py").exists():  # the file may stay where the folder goes
        (tmp_path / "corpus_pipeline.py").symlink_to(REPO / "corpus_pipeline.py")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; assert not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and 'pipeline' not in e.queries() and len(e.queries()) > 50"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]

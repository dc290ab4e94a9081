import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_stands_alone():
    """Without corpus_pipeline and the llm package the rest still imports."""
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['keyloom.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tidemill.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "q01_query_funnel" in q and set(o) <= set(q)
assert not [n for n in q if n.startswith("op") or n == "pipeline"]
assert not [m for m in sys.modules if m.startswith("tidemill.llm")]
"""


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "score" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_training_data_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "tidemill").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f

"""The entry points without the optional subpackage, and without what only it needs."""
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
PROBE = """
import sys, warnings
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if any(name == h or name.startswith(h + ".") for h in {hidden!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
warnings.simplefilter("ignore")
import __spark_entry__ as entry
queries, oracles = entry.queries(), entry.oracle_sql()
assert set(oracles) <= set(queries)
print(len(queries), sum(name.startswith("op") or name == "pipeline" for name in queries))
"""


@pytest.mark.parametrize("hidden", [["textroute.llm", "corpus_pipeline"], ["corpus_pipeline"], ["public_tokenizers"]])
def test_other_queries_stay(hidden):
    run = subprocess.run([sys.executable, "-c", PROBE.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    total, optional = map(int, run.stdout.split())
    assert total >= 113 and optional == 0


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "textroute").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path

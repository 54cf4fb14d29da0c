"""The driver contract, and that the training-data subpackage can be taken away."""

import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == "corpus_pipeline" or name.startswith("tamarack.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert "bm25_topk" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names), names
assert set(e.oracle_sql()) <= names
"""


def imports(path: Path) -> set[str]:
    found = set()
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            found |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            found |= {node.module or ""} | {f"{node.module}.{a.name}" for a in node.names}
    return found


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tamarack").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any("llm" in name.split(".") for name in imports(path)), path


def test_the_entry_works_without_the_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_local_checkpoints():
    for path in [*(ROOT / "tamarack").rglob("*.py")]:
        assert "localCheckpoint" not in path.read_text(), path

"""The driver's contract holds with and without the text operators."""

import importlib
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = str(Path(__spark_entry__.__file__).parent)


def test_without_the_text_operators():
    code = "import sys; sys.modules['rasterfold.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q and 'op1_nearest' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_nothing_else_needs_them():
    for path in Path(ROOT, "rasterfold").rglob("*.py"):
        if "llm" not in path.parts:
            assert "rasterfold.llm" not in path.read_text() and importlib.util.find_spec(".".join(path.relative_to(ROOT).with_suffix("").parts))

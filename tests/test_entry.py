import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_optional_subpackage():
    for path in (ROOT / "loreweave").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "loreweave").parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path


def test_entry_without_the_optional_subpackage():
    code = "import sys; sys.modules['loreweave.llm'] = None\nimport __spark_entry__ as e\nassert 'p3_found' in e.queries() and 'p8_ids' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)

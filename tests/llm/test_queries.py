from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import pytest

from gridload.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

SF = "/root/testdata/sf0.01"
ORACLES = queries.all_oracles()


@pytest.mark.parametrize("name", ["op1_secrets", "op5_decontaminate", "op10_licences"])
def test_matches_sql(spark, name):
    df = queries.all_queries()[name](spark, SF)
    assert oracle.spark_rows(df) == oracle.oracle_rows(oracle.connect(SF), ORACLES[name])


def test_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    numbers = {int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n))}
    assert numbers == set(range(1, 14)) and "pipeline" in entry.queries()
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_entry_works_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    (tmp_path / "gridload").mkdir()
    for part in (root / "gridload").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "gridload" / part.name).symlink_to(part)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import re, __spark_entry__ as e; print(sum(bool(re.match(r'op[0-9]|pipeline', n)) for n in e.queries()))"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert run.stdout.strip() == "0", run.stderr

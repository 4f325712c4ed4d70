"""The entry on a copy without the training-data package: it imports, and the other queries run."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

PROBE = """
import __spark_entry__ as entry

found = entry.queries()
assert "for_digest" in found and "pipeline" not in found
assert not [name for name in found if name.startswith("op")]
assert set(entry.oracle_sql()) <= set(found)
"""

RUN = """
from vacantia.session import build_session

spark = build_session("probe", "local[2]", **{"spark.ui.enabled": "false"})
print("ROWS", found["boards"](spark, "/root/testdata/sf0.001").count())
"""


def _copy(to: Path, *left_out: str) -> None:
    def ignored(folder: str, names: list[str]) -> set[str]:
        inside = Path(folder).resolve().relative_to(REPO)
        return {n for n in names if str(inside / n) in left_out or n in (".git", "__pycache__")}

    shutil.copytree(REPO, to, ignore=ignored)


def _run(folder: Path, code: str) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run(
        [sys.executable, "-B", "-c", code],
        cwd=folder, env=env, capture_output=True, text=True, check=True, timeout=300,
    ).stdout


def test_runs_without_the_training_data_package(tmp_path):
    _copy(tmp_path / "a", "vacantia/llm", "tests/llm", "corpus_pipeline.py")
    assert int(_run(tmp_path / "a", PROBE + RUN).split("ROWS")[1]) > 0


def test_a_pipeline_file_left_behind_is_passed_by(tmp_path):
    _copy(tmp_path / "b", "vacantia/llm", "tests/llm")
    _run(tmp_path / "b", PROBE)

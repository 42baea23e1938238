"""The package reaches Python workers of a session that was started in another folder."""

from __future__ import annotations

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})
from moodwire.session import build
import __spark_entry__ as e
spark = build("local[2]", 2, **{{"spark.checkpoint.dir": "file://" + {scratch!r}}})
print("ROWS", e.queries()["t2_tenant_limit"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_workers_find_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(repo=repo, scratch=str(tmp_path / "scratch"))
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "ROWS " in done.stdout, done.stderr[-2000:]

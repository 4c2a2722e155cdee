"""The package reaches the workers from any working directory."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from logtide.session import local_session
spark = local_session(2, "ship")
spark.sparkContext.setLogLevel("ERROR")
print("rows", entry.queries()["dedup_alerts"](spark, {data!r}).count())
"""


def test_from_a_foreign_directory(small_dir, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=root, data=small_dir)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert int(done.stdout.split("rows")[-1]) > 0

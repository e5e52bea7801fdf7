"""A session where the Spark configuration names no checkpoint folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
from docweave.session import ensure_checkpoint_dir, get_session, reliable_checkpoint, scratch_dir
s = get_session("local[1]", shuffle_partitions=1)
d = ensure_checkpoint_dir(s)
assert d == ensure_checkpoint_dir(s) and scratch_dir(s, "x").startswith(d)
assert reliable_checkpoint(s.range(3)).count() == 3
print("fine")
"""


def test_no_folder_configured(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=180)
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]

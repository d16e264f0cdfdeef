"""Workers can import the package when the driver runs in another folder without it on the path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_package_reaches_workers(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from spanqa.session import local_session
spark = local_session(2, shuffle_partitions=2)
def run(batches):
    from spanqa.functions.longest_match import LongestMatch
    for b in batches:
        yield b.slice(0, len(LongestMatch([("a", 1)], "##")("a")))
print("rows", spark.range(1).mapInArrow(run, "id long").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 1" in out.stdout, out.stderr[-2000:]

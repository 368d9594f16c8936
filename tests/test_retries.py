import os
import subprocess
import sys

from tests.conftest import ROOT


def test_results_survive_task_retries():
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "tools", "retry_check.py"), "/root/testdata/sf0.001"],
        capture_output=True, text=True, timeout=600,
    )
    assert out.stdout.strip().splitlines()[-1] == "OK", out.stdout[-2000:] + out.stderr[-2000:]

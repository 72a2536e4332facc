import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location('__spark_entry__', r'%s/__spark_entry__.py')
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from loanframe.session import local_session
spark = local_session(cores=2, shuffle_partitions=2)
print('ROWS', entry.queries()['x2_gram'](spark, '/root/testdata/sf0.001').count())
"""


def test_arrow_query_from_another_folder(tmp_path):
    """Python workers get the package from the session, not from the working folder or PYTHONPATH."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT % ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in out.stdout, out.stderr[-2000:]

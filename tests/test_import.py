"""The library and its entry can be imported where no session runs yet."""

import os
import pkgutil
import subprocess
import sys

import corpusloom

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_without_a_session():
    names = [m.name for m in pkgutil.walk_packages(corpusloom.__path__, "corpusloom.")]
    code = "import importlib, __spark_entry__\n__spark_entry__.queries(), __spark_entry__.oracle_sql()\n" + "\n".join(f"importlib.import_module({n!r})" for n in names)
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr

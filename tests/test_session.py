"""The shared folder: a clear error without one, a given one where none is configured."""

import subprocess
import sys

import pytest

CODE = """
import sys
from tablekit.session import get_session, shared_path
spark = get_session("local[1]", 1, checkpoint_dir={folder!r}, extra_conf={{"spark.ui.showConsoleProgress": "false"}})
try:
    print("PATH", shared_path(spark, "x"))
    print("ROWS", spark.range(3).checkpoint().count())
except RuntimeError as e:
    print("ERROR", e)
"""


@pytest.mark.parametrize("given", [False, True])
def test_shared_folder(tmp_path, given):
    import os
    folder = str(tmp_path / "shared") if given else None
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    out = subprocess.run([sys.executable, "-c", CODE.format(folder=folder)], env=env, capture_output=True, text=True,
                         timeout=180, check=True).stdout
    if given:
        assert "ROWS 3" in out and folder in out
    else:
        assert "ERROR spark.checkpoint.dir is not set" in out

"""The session keeps what its submitter has set."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code: str, **env) -> str:
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=REPO, env=os.environ | env)
    assert got.returncode == 0, got.stderr[-2000:]
    return got.stdout.strip().splitlines()[-1]


SHOW = "print(*[s.conf.get(k) for k in ('spark.sql.session.timeZone', 'spark.sql.adaptive.enabled', 'spark.sql.shuffle.partitions')])"


def test_a_running_session_is_taken_as_it_is():
    assert run(f"""
from pyspark.sql import SparkSession
SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.session.timeZone', 'Asia/Tokyo').config(
    'spark.sql.adaptive.enabled', 'false').config('spark.sql.shuffle.partitions', '3').getOrCreate()
from fathom.session import get_session
s = get_session('local[1]', 8)
{SHOW}""") == "Asia/Tokyo false 3"


def test_submitted_keys_stay_and_others_are_filled():
    assert run(f"from fathom.session import get_session; s = get_session('local[1]', 8); {SHOW}",
               PYSPARK_SUBMIT_ARGS="--conf spark.sql.session.timeZone=Asia/Tokyo pyspark-shell") == "Asia/Tokyo true 8"


def test_the_checkpoint_folder_is_the_configured_one(tmp_path):
    assert run("from fathom.session import get_session, ensure_checkpoint_dir; print(ensure_checkpoint_dir(get_session('local[1]')))",
               PYSPARK_SUBMIT_ARGS=f"--conf spark.checkpoint.dir={tmp_path}/shared pyspark-shell").startswith(f"file:{tmp_path}/shared")

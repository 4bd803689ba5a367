"""Jobs whose Python workers import the package must run from any working
directory (the package is shipped with addPyFile, as --py-files would)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {os.path.join(REPO, "__spark_entry__.py")!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
     .config("spark.ui.showConsoleProgress", "false").getOrCreate())
s.sparkContext.setLogLevel("ERROR")
print("ROWS", E.queries()["compound_cap"](s, "/root/testdata/sf0.001").count(),
      E.queries()["vector_topk"](s, "/root/testdata/sf0.001").count())
"""


def test_python_worker_jobs_run_outside_the_repo():
    cwd = tempfile.mkdtemp(prefix="intentlane-cwd-", dir="/tmp")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", SCRIPT], cwd=cwd, env=env,
                         capture_output=True, text=True, timeout=600)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("ROWS")]
    assert line, out.stderr[-3000:]
    n_events, n_hits = map(int, line[0].split()[1:])
    assert n_events > 0 and n_hits > 0


def test_arrow_batches_are_limited_by_bytes(spark):
    """Long texts: a batch holds about 4 MB, where Spark's own limit is 64 MB; a submitter's limit stays."""
    import pyarrow as pa
    from pyspark.sql import functions as F
    from intentlane import session

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        session.limit_batches(spark)
        texts = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 2500).alias("t"))     # 20 MB
        got = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 20_000_000 and max(got) < 2 * session.BATCH_BYTES
        spark.conf.set(key, "12345")
        session.limit_batches(spark)
        assert spark.conf.get(key) == "12345"
    finally:
        spark.conf.unset(key)
        if old is not None:
            spark.conf.set(key, old)

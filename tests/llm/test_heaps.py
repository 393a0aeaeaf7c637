"""A stage of the pipeline doesn't begin with the heaps that the stage before has enlarged."""

import json
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parents[2]

SCRIPT = """
import json, os, re, sys
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
import corpus_pipeline

def executor():
    for p in Path("/proc").iterdir():
        try:
            if p.name.isdigit() and b"CoarseGrainedExecutorBackend" in (p / "cmdline").read_bytes() and sys.argv[1].encode() in (p / "environ").read_bytes():
                return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", (p / "smaps_rollup").read_text()))) // 1024
        except OSError:
            pass

conf = {"spark.master": "local-cluster[1,1,1024]", "spark.executor.memory": "900m", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"}
conf |= {"spark.driver.host": "127.0.0.1", "spark.driver.memory": "512m", "spark.checkpoint.dir": sys.argv[1]}
spark = SparkSession.builder.config(map=conf).config("spark.executorEnv.HEAP_TEST", sys.argv[1]).getOrCreate()
docs = spark.createDataFrame([(1, "one text", "a")], "doc_id long, text string, source string")
key, value = (F.col("id") % 1_500_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")
spark.range(3_000_000).select(key, value).groupBy("k").agg(F.max("v")).write.format("noop").mode("overwrite").save()
before = executor()
dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, "")
print(json.dumps([before, executor()]))
os._exit(0)
"""


def test_stages_begin_with_small_heaps(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=REPO, capture_output=True, text=True, timeout=240)
    before, after = json.loads(next(x for x in done.stdout.splitlines() if x.startswith("[") and x.endswith("]")))
    assert before > 500 and after < before - 200, (before, after)

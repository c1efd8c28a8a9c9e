"""What Python workers hold: the batches that they are sent, and what they keep once a task is over."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parents[2]
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCHES = """
import public_tokenizers
from pyspark.sql import functions as F
from folioforge.llm.byte_bpe import encode_and_decode, encode_documents
from folioforge.llm.queries_bpe import RANKS
from folioforge.llm.suffix_dedup import remove_repeats
from folioforge.session import build_session

def sizes(batches):
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
for name, f in (("encode", lambda d: encode_documents(d, path, pattern)), ("both", lambda d: encode_and_decode(d, path, pattern)), ("repeats", lambda d: remove_repeats(d, ("doc_id",), as_text=True))):
    spark = build_session("local[1]", 1, "2g")
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 300).alias("text")).coalesce(1)
    f(docs.limit(3)).count()  # whoever writes the result, the size of batches holds
    print("most", name, max(r.n for r in docs.mapInArrow(sizes, "n long").collect()))
    spark.stop()
"""
KEPT = """
import re
from pathlib import Path
from pyspark.sql import functions as F
from folioforge.llm.suffix_dedup import remove_repeats
from folioforge.session import build_session

def held(batches):
    import os
    import pyarrow as pa
    for b in batches:
        mb = sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024
        yield pa.RecordBatch.from_arrays([pa.array([mb]), pa.array([os.getpid()])], ["mb", "pid"])

spark = build_session("local[1]", 1, "2g")
word = F.substring(F.sha2(F.concat_ws(" ", F.col("id"), F.col("k")), 256), 1, 60)
docs = spark.range(8000).select("id", F.explode(F.sequence(F.lit(1), F.lit(90))).alias("k")).select("id", word.alias("w"))
docs = docs.groupBy("id").agg(F.array_join(F.collect_list("w"), " ").alias("text")).withColumnRenamed("id", "doc_id")
docs.write.parquet("{path}")
probe = lambda: {r.pid: r.mb for r in spark.range(1).mapInArrow(held, "mb long, pid long").collect()}
docs = spark.read.parquet("{path}")
remove_repeats(docs.limit(10)).count()
before = probe()
remove_repeats(docs).write.format("noop").mode("overwrite").save()
after = probe()
print("kept", max(after[p] - before.get(p, 0) for p in after), before, after)
"""


def run(code: str) -> str:
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert not done.returncode, done.stderr[-3000:]
    return done.stdout


def test_workers_are_sent_few_bytes_at_a_time():
    most = {name: int(n) for name, n in re.findall(r"most (\w+) (\d+)", run(BATCHES))}
    assert set(most) == {"encode", "both", "repeats"} and max(most.values()) < 10 << 20, most


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_workers_keep_little_after_a_task(tmp_path):
    out = run(KEPT.replace("{path}", f"{tmp_path}/docs"))
    assert int(re.search(r"kept (-?\d+)", out)[1]) < 40, out


def test_a_smaller_batch_of_the_session_stays(spark):
    from folioforge.llm.common import mapped

    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, "1m")
        assert mapped(spark.range(3), lambda batches: batches, "id long").count() == 3 and spark.conf.get(BATCH) == "1m"
    finally:
        spark.conf.set(BATCH, before)

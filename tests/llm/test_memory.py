"""What Python workers keep after a stage counts in the next one too."""

import re
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import packing, substring
from quern.llm.tokenizing import vocabulary


@pytest.mark.parametrize("stage", ["substrings", "packing"])
@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_workers_give_back_what_a_stage_freed(spark, stage):
    words = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.substring(F.sha1((F.col("id") * 400 + k).cast("string")), 1, 6))

    def held(batches):  # MB of this worker's own memory
        for _ in batches:
            time.sleep(0.5)  # so that each of the tasks gets a worker of its own
            yield pa.RecordBatch.from_arrays([pa.array([int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10])], ["mb"])

    docs = spark.range(0, 8000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"))
    if stage == "substrings":
        out = substring.remove_repeats(spark, docs)
    else:
        out = packing.pack(spark, docs, vocabulary("byte_bpe_50k.json"), with_ids=False)
    out.write.format("noop").mode("overwrite").save()
    most = max(r["mb"] for r in spark.range(0, 4, numPartitions=4).mapInArrow(held, "mb long").collect())
    assert most < {"substrings": 120, "packing": 180}[stage]

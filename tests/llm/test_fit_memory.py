"""What a fit leaves behind in the driver."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from fleetseal.llm import toxicity


def held_mb():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def labelled(spark, rows):
    words = F.expr("transform(sequence(1, 1500), x -> concat('a', cast(pmod(xxhash64(id, x), 40000) as string), repeat('letters', 4)))")
    return spark.range(rows).select(F.concat_ws(" ", words).alias("text"), (F.col("id") % 3).cast("int").alias("grade"))


def test_a_fit_gives_its_sample_up(spark):
    toxicity.fit(labelled(spark, 10), 3)  # imports and first use
    before = held_mb()
    toxicity.fit(labelled(spark, 3000), 3)
    assert held_mb() - before < 20

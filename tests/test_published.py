"""Published tables, read from the folder named by CORPUSLENS_PUBLISHED (skipped if unset).

The folder holds scores.csv: dataset_id and one column per method.
"""

import os

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import protocol as pr
from corpuslens.operators import rank as rk

FOLDER = os.environ.get("CORPUSLENS_PUBLISHED")
pytestmark = pytest.mark.skipif(not FOLDER, reason="CORPUSLENS_PUBLISHED is not set")


def test_average_rank_summaries(spark):
    wide = spark.read.csv(f"{FOLDER}/scores.csv", header=True)
    methods = wide.columns[1:]
    order = F.create_map(*[F.lit(x) for i, m in enumerate(methods) for x in (m, i + 1)])
    perf = wide.select("dataset_id", *[F.col(m).cast("double") for m in methods]).unpivot(
        ["dataset_id"], methods, "algorithm", "value").withColumn("alg_ord", order[F.col("algorithm")])
    r = rk.ranks(perf)
    s = rk.average_rank(r, pr.self_groups(perf)).withColumn("treatment", F.lit("ar"))
    out = pr.summary(pr.evaluate(s, perf, r)).first()
    assert abs(out.mean_spearman - 0.7483636363636365) < 1e-12
    assert abs(out.std_spearman - 0.29971780109479307) < 1e-12
    assert abs(out.mean_auc_loss - 0.0021072188419707645) < 1e-12
    assert abs(out.loss_t1 - 0.016436240750808413) < 1e-12

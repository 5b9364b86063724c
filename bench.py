"""Times the headline queries, a first and a warm run of each, and prints one JSON line with the warm times."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantrail.operators import sampling, statistics
from quantrail.plans.models import MODELS
from quantrail.queries import QUERIES
from quantrail.sources.folders import cut

NAMES = ("npv_of_revenue", "describe_prices", "histogram_25", "spearman_by_flag", "sensitivity_of_price", "regression_coefficients", "cash_flow_indicators", "internal_rate", "loan_french", "autocorrelations", "forecast_errors", "optimise_inventory", "process_gbm", "conditional_totals", "lookup_below", "fit_ranking")
#: Trials of the published workload.
TRIALS = (100_000,)


def project(spark: SparkSession, trials: int) -> list[DataFrame]:
    """The published workload: the project model, Latin hypercube and rank correlation, both forecasts with all percentiles, and sensitivity."""
    model = MODELS["project"]()
    done = cut(sampling.simulate(spark, model, trials, method="lhs").select("trial", *model.assumptions, *model.outputs))
    long = done.select(F.explode(F.array(*[F.struct(F.lit(o).alias("forecast"), F.col(o).alias("x")) for o in model.outputs])).alias("f")).select("f.*")
    return [statistics.describe(long, "x", ["forecast"]), statistics.sensitivity(done, [*model.assumptions], "npv")]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{folder}", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    first: dict[str, float] = {}
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        for into in (first, times):
            began = time.time()
            for df in run():
                df.write.format("noop").mode("overwrite").save()
            into[name] = round(time.time() - began, 3)

    for name in NAMES:
        timed(name, lambda name=name: [QUERIES[name](spark, sf)])
    for trials in TRIALS:
        timed(f"project_{trials}", lambda trials=trials: project(spark, trials))
    print(json.dumps({"metric": "total of the headline queries, warm", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "first_run": first, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

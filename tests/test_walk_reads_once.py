"""A walk-forward derives its panel once, whatever reads it afterwards."""

import datetime as dt

import pyarrow as pa
from pyspark.sql import functions as F

from panelloom.operators import learners


def test_walk_forward_of_trees_derives_the_panel_once(spark):
    months = [dt.date(2000, m, 1) for m in range(1, 7)]
    rows = [(d, i, float(i * 7 % 11), float(i % 5) - 2) for d in months for i in range(20)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    panel = spark.createDataFrame(rows, "month date, id long, x double, y double")
    panel = panel.mapInArrow(count, "month date, id long, x double, y double")
    train, test = panel.where(F.col("month") < months[3]), panel.where(F.col("month") >= months[3])
    model = learners.boosted_trees(["x"], "y", n_estimators=2, max_depth=2)
    side, walked = learners.predict(model, train, test, ["month", "id"], "month", expand_window=True)
    assert walked.where("pred IS NOT NULL").count() == 60
    assert side.count() == 100
    # The two sides are two scans of the panel that are written together.
    assert seen.value <= 2 * len(rows)

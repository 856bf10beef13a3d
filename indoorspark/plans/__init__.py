"""All registered queries."""

from indoorspark.plans import basics, features, helpers, io, matching, rasters, retracing  # noqa: F401
from indoorspark.plans.registry import QUERIES, SQL


def flagship(spark, sf_dir):
    return QUERIES["W1_paint_order"](spark, sf_dir)


__all__ = ["QUERIES", "SQL", "flagship"]

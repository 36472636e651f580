"""Evaluation of panel forecasts on Spark: panels, splits, origins, errors, reports."""

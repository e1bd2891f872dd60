"""Quantile models fitted for all series, folds and levels at once.

A model is a row ``(series_id, fold, params)``.  Training data stay partitioned by
(series, block of rows); every pass over them is one Spark job that sums small
statistics per model, and the model rows are updated from the sums.  The number of
jobs does not depend on how many series, folds or levels there are.
"""

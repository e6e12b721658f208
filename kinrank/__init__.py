"""kinrank: explicit-feedback collaborative filtering on Spark DataFrames.

Three recommenders (per-item mean baseline, user-neighbourhood model on
mean-centred cosine similarity, ALS matrix factorisation) and their
evaluation (RMSE, per-key RMSE, top-k precision, coverage, quantile
buckets, parameter and sample-size sweeps).  Every step takes and returns
Spark DataFrames; nothing is collected to the driver except one-row
results and tiny per-partition bookkeeping.

Layout:
  sources/    readers for ratings and items, result-set sinks
  operators/  cleaning and splitting, baseline, neighbourhood, ALS
  functions/  column expressions, ranking helpers, metrics
  plans/      experiments, the registered query catalogue and its oracle SQL
"""

__version__ = "0.1.0"

# Default column names used throughout the package.
USER = "user_id"
ITEM = "item_id"
RATING = "rating"
TS = "ts"

"""Panel, matching and resampling estimators as aggregations over distributed tables."""

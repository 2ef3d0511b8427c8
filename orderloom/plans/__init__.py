"""Models and queries of the warehouse: DataFrame in, DataFrame out, no writes."""

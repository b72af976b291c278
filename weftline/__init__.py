"""Feature engineering and model ensembling over relational data, as fused Spark DataFrame plans."""

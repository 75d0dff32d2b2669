"""plumbline: honest tabular experiments, expressed as Spark DataFrame plans."""

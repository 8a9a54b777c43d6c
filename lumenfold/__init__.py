"""lumenfold: planning cubes compiled to Spark DataFrame plans."""

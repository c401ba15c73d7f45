"""rulestream: source-code security analytics expressed as Spark DataFrame plans."""

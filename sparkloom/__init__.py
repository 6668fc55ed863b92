"""sparkloom: instruction-tuning data preparation and model evaluation as lazy Spark plans."""

"""skein: property-graph and table analytics expressed as Spark DataFrame plans."""

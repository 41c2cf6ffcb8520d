"""lodemap: data-map analytics written as Spark DataFrame plans."""

"""Analytics on sequencing data and text corpora as Spark DataFrame plans."""

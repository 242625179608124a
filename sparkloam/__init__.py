"""sparkloam: typed record tables on Spark - layout, pruning, filters, rounding and intervals."""

"""strandline: typed property graphs, lookups and graph analysis as Spark plans."""

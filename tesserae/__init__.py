"""tesserae: index, expression, keyed-store and dataflow operators as Spark plans."""

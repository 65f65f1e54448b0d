"""Functions of the embedded dialect as Spark SQL text: each takes translated arguments and gives text and type."""

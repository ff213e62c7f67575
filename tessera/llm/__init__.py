"""Training-data operators: ten corpus operators and the queries that apply them.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when the package is present."""

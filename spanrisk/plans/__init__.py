"""Stage composition, the batch job and the registered queries with their SQL oracles."""

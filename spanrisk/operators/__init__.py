"""DataFrame -> DataFrame and Column -> Column operators of the risk engine."""

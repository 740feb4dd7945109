"""Record reconciliation, mastering and estate analytics on Spark DataFrames."""

"""leafloom: document abstraction and reading analytics on Spark DataFrames."""

"""promptmill: semantic-cache analytics for prompts and answers on Spark DataFrames."""

__version__ = "0.1.0"

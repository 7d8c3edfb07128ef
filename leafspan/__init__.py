"""Analytics over documents held as tables of words with boxes, built on Spark DataFrames."""

__version__ = "0.1.0"

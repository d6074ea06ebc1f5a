"""detlake: detection-dataset curation, evaluation and review on Spark DataFrames."""

__version__ = "0.1.0"

"""Series metadata engine: fold, clean, featurise, score and evaluate image-series metadata on Spark."""

__version__ = "0.1.0"

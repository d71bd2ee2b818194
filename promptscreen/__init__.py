"""promptscreen: bulk screening of text prompts on Apache Spark.

Prepare labelled prompt tables, featurize them with TF-IDF, train
class-balanced classifiers, score through a two-stage cascade, evaluate,
explain and stress-test with word substitutions -- all as DataFrame jobs.
"""

__version__ = "0.1.0"

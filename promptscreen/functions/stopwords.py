"""English stop words, read from the list that ships with Spark ML."""

from __future__ import annotations

import glob
import importlib.util
import os
import zipfile
from functools import lru_cache

_ENTRY = "org/apache/spark/ml/feature/stopwords/english.txt"


@lru_cache(maxsize=1)
def english() -> tuple[str, ...]:
    """The words of ``StopWordsRemover.loadDefaultStopWords("english")``, read
    from the jar, so that no session is needed when a module is imported."""
    home = os.environ.get("SPARK_HOME") or os.path.dirname(importlib.util.find_spec("pyspark").origin)
    for jar in glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as z:
            if _ENTRY in z.namelist():
                return tuple(w for w in z.read(_ENTRY).decode("utf-8").split("\n") if w)
    from pyspark.ml.feature import StopWordsRemover
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))

"""segspark: Thai text normalization, clustering and word segmentation on Spark DataFrames."""

from segspark.functions.clusters import cluster_ends, clusters
from segspark.functions.normalize import normalize
from segspark.functions.segment import register_functions, segment
from segspark.operators.dictionary import load_dict

__all__ = ["cluster_ends", "clusters", "load_dict", "normalize", "register_functions", "segment"]
__version__ = "0.1.0"

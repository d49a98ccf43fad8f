"""The methods as generators: a Progress after every iteration; send() new data."""

from ..operators.clustering import efcm, fcm, kmeans, rcm, rmcm
from ..operators.maps import batch_som, som, som_olp
from . import apply

__all__ = ["apply", "batch_som", "efcm", "fcm", "kmeans", "rcm", "rmcm", "som", "som_olp"]

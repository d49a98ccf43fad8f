"""Trained prototypes applied, as generators."""

from ..operators.clustering import apply_efcm as efcm
from ..operators.clustering import apply_fcm as fcm
from ..operators.clustering import apply_kmeans as kmeans
from ..operators.clustering import apply_rcm as rcm
from ..operators.clustering import apply_rmcm as rmcm
from ..operators.maps import apply_batch_som as batch_som
from ..operators.maps import apply_som as som
from ..operators.maps import apply_som_olp as som_olp

__all__ = ["batch_som", "efcm", "fcm", "kmeans", "rcm", "rmcm", "som", "som_olp"]

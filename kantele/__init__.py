"""Prototype-based analytics and corpus preparation on Spark.

Methods take a DataFrame, ``features`` (column names, or one column of arrays) and
``id_col``. ``kantele.steps`` has them as generators, ``kantele.apply`` applies
trained prototypes.
"""

from . import apply, steps
from .functions.columns import effective_units, membership_entropy, scaling, standardized
from .operators.clustering import Partial, merged_update, partial_update
from .operators.metrics import Neighborhood, ami, ari, contingency, continuity, trustworthiness
from .operators.search import TPE, SearchResult, TPEResult, choice, integer, loguniform, minimize, uniform
from .plans.engine import Progress, Result
from .plans.engine import to_end as _to_end
from .sources.store import Trained, load, save
from .streaming.fitting import BackgroundRun, StreamedFit

kmeans, fcm, efcm, rcm, rmcm = (_to_end(f) for f in (steps.kmeans, steps.fcm, steps.efcm, steps.rcm, steps.rmcm))
som, batch_som, som_olp = (_to_end(f) for f in (steps.som, steps.batch_som, steps.som_olp))

__all__ = [
    "BackgroundRun", "Neighborhood", "Partial", "Progress", "Result", "SearchResult", "StreamedFit", "TPE", "TPEResult", "Trained", "ami", "apply", "ari",
    "batch_som", "choice", "contingency", "continuity", "effective_units", "efcm", "fcm", "integer", "kmeans", "load", "loguniform",
    "membership_entropy", "merged_update", "minimize", "partial_update", "rcm", "rmcm", "save", "scaling", "som", "som_olp", "standardized", "steps", "trustworthiness",
    "uniform",
]

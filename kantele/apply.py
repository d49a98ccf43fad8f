"""Trained prototypes applied to new rows; they stay exactly as given."""

from .plans.engine import to_end as _to_end
from .steps import apply as _steps

kmeans, fcm, efcm, rcm, rmcm = (_to_end(f) for f in (_steps.kmeans, _steps.fcm, _steps.efcm, _steps.rcm, _steps.rmcm))
som, som_olp = _to_end(_steps.som), _to_end(_steps.som_olp)
batch_som = som

__all__ = ["batch_som", "efcm", "fcm", "kmeans", "rcm", "rmcm", "som", "som_olp"]

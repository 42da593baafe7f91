"""Literal models, so that applying them can be checked without fitting anything."""

from creditloom.fixed import CLUSTER_FEATURES, MODEL_FEATURES
from creditloom.functions.scoring import LinearModel
from creditloom.operators.segmentation import Segmentation

_MEDIANS = (538000.0, 1050000.0, 12500.0, -16200.0, -4200.0, 0.5, 0.49, 0.51, 2.0, 0.024)
_MEANS = (537700.0, 1052000.0, 12540.0, -16170.0, -4990.0, 0.5, 0.5, 0.5, 3.3, 0.039)
_STDS = (285000.0, 605000.0, 7170.0, 4900.0, 3700.0, 0.2, 0.29, 0.26, 6.1, 0.073)
_FIRST = (-0.05, 0.1, -0.08, 0.12, 0.07, -0.15, -0.75, -0.2, 0.06, -0.04)
_SECOND = (0.02, -0.03, 0.05, 0.04, -0.06, -0.3, -1.1, 0.15, -0.02, 0.08)


def _model(weights: tuple[float, ...], intercept: float) -> LinearModel:
    return LinearModel(
        dict(zip(MODEL_FEATURES, weights, strict=True)),
        intercept,
        dict(zip(MODEL_FEATURES, _MEDIANS, strict=True)),
        dict(zip(MODEL_FEATURES, zip(_MEANS, _STDS, strict=True), strict=True)),
    )


FIRST = _model(_FIRST, -1.3)
SECOND = _model(_SECOND, -1.1)

SEGMENTS = Segmentation(
    list(CLUSTER_FEATURES),
    dict(
        zip(
            CLUSTER_FEATURES,
            ((0.5, 0.2), (2.9, 3.4), (0.035, 0.04), (44.3, 13.4), (13.4, 10.4)),
            strict=True,
        )
    ),
    ((0.8, -0.2, -0.2, 0.4, 0.2), (-0.8, -0.2, -0.2, -0.4, -0.1), (0.0, 2.2, 2.2, 0.1, 0.3)),
    0.0,
)

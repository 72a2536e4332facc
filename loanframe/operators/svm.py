"""Linear SVMs with the squared hinge.

Objective (liblinear primal, bias as a feature with value 1, penalised):
L2:  1/2 |beta|^2 + C * sum_i w_i max(0, 1 - y_i f_i)^2
L1:  |beta|_1     + C * sum_i w_i max(0, 1 - y_i f_i)^2
solved by the proximal Newton solver: each step is one distributed pass
forming the generalised Hessian over the margin-violating rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from loanframe.functions import newton
from loanframe.functions.gram import Interactions
from loanframe.operators.models import FEATURES, LABEL, LinearScorer, with_weights


def fit_linear_svc(train: DataFrame, C: float = 1.0, penalty: str = "l2",
                   weights: dict[int, float] | None = None, max_iter: int = 50,
                   features: str = FEATURES, label: str = LABEL, name: str = "LinearSVC",
                   expand: Interactions | None = None) -> LinearScorer:
    d = with_weights(train, weights, label)
    l1, l2 = (1.0, 0.0) if penalty == "l1" else (0.0, 1.0)
    w, b, info = newton.fit(d, features, label, "squared_hinge", "weight", C=C, l1=l1, l2=l2,
                            penalize_intercept=True, max_iter=max_iter, expand=expand)
    return LinearScorer(name, w, b, info={"C": C, "penalty": penalty, **info})

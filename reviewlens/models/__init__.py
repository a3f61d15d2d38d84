from reviewlens.models.baselines import (
    BaselineSettings,
    linear_attributions,
    prepare_features,
    train_and_evaluate,
)
from reviewlens.models.calibrated_svm import CalibratedSVMModel, fit_calibrated_svm
from reviewlens.models.naive_bayes import NaiveBayesTable, fit_naive_bayes

__all__ = [
    "BaselineSettings", "CalibratedSVMModel", "NaiveBayesTable", "fit_calibrated_svm",
    "fit_naive_bayes", "linear_attributions", "prepare_features", "train_and_evaluate",
]

from tacit.sources.feedback import Feedback, implicit, read_feedback, scan_feedback
from tacit.sources.models import FactorModel, load_model, save_model

__all__ = [
    "FactorModel",
    "Feedback",
    "implicit",
    "load_model",
    "read_feedback",
    "save_model",
    "scan_feedback",
]

"""fraudlens: card-fraud feature engineering, rule scoring, decisions, model
evaluation and monitoring expressed as Spark DataFrame / SQL plans."""

__version__ = "0.1.0"

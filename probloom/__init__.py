"""probloom: probabilistic analytics and data preparation as Spark plans.

The package models tables that mix continuous, discrete and categorical
columns with sum-product networks, and prepares such tables for training.
Everything heavy is a DataFrame plan; the driver only ever holds models,
schemas and bounded statistics.
"""

__version__ = "0.1.0"

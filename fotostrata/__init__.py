"""fotostrata: a PySpark-native engine for media metadata.

Every file, capture, rule or text is a row of a DataFrame; operators are plans
of built-in column expressions and, where those cannot express the semantics,
Arrow batches.
"""

__version__ = "0.1.0"

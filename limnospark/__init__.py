"""limnospark: Spark-native feature, validation and scoring operators for
environmental monitoring tables (observations keyed by place and date).

Sub-packages:
  sources    - scans and sinks (CSV, JSON run artifacts, raster point sampling)
  functions  - column expressions (key parsing, geodesy, formula packs, transforms)
  operators  - DataFrame -> DataFrame operators (windows, aggregates, joins,
               spatial joins, folds, encodings, ranking, blending, evaluation,
               quality checks, MLlib models, registry jobs)
  plans      - the registered queries that run the operators on the driver tables
  streaming  - incremental (micro-batch) application of the batch operators
"""

__version__ = "0.1.0"

"""Incremental application of the batch operators.

2.13), so there is no streaming operator to rebuild. This package only
adapts the batch operators to Structured Streaming micro-batches for users
who land new observation files continuously: every micro-batch goes through
a batch operator and becomes one partition of a Parquet table; the stream checkpoint
lives under the cluster's shared ``spark.checkpoint.dir``.
"""

from .incremental import append_each_batch  # noqa: F401

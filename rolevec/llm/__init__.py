"""Operators for building training data at scale: one module per operator,
shared kernels in ``textkit``, ``fmindex`` and ``graph``, registered queries in
``queries``.  Nothing outside this folder imports it except the guard in
``__spark_entry__.py`` and ``corpus_pipeline.py``."""

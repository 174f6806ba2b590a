"""Operators of a training-data pipeline over documents, pages and
conversations. Nothing outside this package (and ``corpus_pipeline.py``,
which belongs to it) imports it; ``queries.py`` holds what it registers.

Conventions of every operator here: it projects its input to the columns it
names first, so extra columns, also ones named like its outputs, are
ignored; a NULL text counts as an empty text; repeated input rows are
answered once each; an empty table gives an empty result with the same
schema. Deviations stand in the operator's docstring."""

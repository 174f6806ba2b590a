"""Stipend and meal-attendance analytics as Spark DataFrame jobs.

Every public function takes DataFrames (plus an explicit clock where the
source system used ``NOW()`` / ``CURRENT_DATE``) and returns DataFrames.
Nothing is collected to the driver; the caller decides the sink.

Modules:

* ``stipendlens.operators.reports``   R1-R22 reports, dual claims, student portal
* ``stipendlens.operators.views``     presentation columns (labels, formats)
* ``stipendlens.operators.quality``   rule builders, ``violations``, ``split_valid``
* ``stipendlens.operators.workflows`` batch write workflows returning ``Result``
* ``stipendlens.streaming``           tick ingest and live dashboard
* ``stipendlens.sources``             fixed-schema reads, loader, test-data mapping
* ``stipendlens.plans``               size-checked broadcast, skew-safe rank, dense ids, checkpoints
* ``stipendlens.jobs``                spark-submit entry points
"""

__version__ = "0.1.0"

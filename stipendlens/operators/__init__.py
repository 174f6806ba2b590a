"""DataFrame-in / DataFrame-out operators: reports, presentation views,
data-quality rules and batch write workflows."""

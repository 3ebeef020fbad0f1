"""veracity: article-trust analytics as Spark DataFrame jobs.

Layout
------
sources/    table readers, the fixture views (articles, analysis history,
            feedback, stored responses) and page extraction
functions/  Column-level expressions (text folding, banding, topic tags,
            scoring arithmetic)
operators/  DataFrame -> DataFrame operators (store, lookup, stats, history,
            feed, scoring jobs)
plans/      shared plan helpers (skew-safe ordered sequences, size-checked
            broadcast), the registered query catalog and its SQL oracles
streaming/  Structured Streaming twins of the stateful operators
"""

__version__ = "0.1.0"

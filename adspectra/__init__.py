"""A PySpark engine for contextual-advertising data: events, rollups, matching, auctions, pacing, evaluation."""

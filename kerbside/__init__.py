"""Lot-occupancy and charger analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames. Timestamps are UTC wall
clock (``TIMESTAMP_NTZ``), so results do not depend on the session time zone, and
no operator reads the clock: the caller passes ``as_of``.
"""

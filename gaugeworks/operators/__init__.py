"""Operators on readings. All take many series at once and keep them apart by series_id."""

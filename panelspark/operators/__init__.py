"""Operators: functions from DataFrame to lazy DataFrame.

Panel contract: one row per (key, idx), where ``idx`` is a dense integer month
number (year * 12 + month) or a session number.  Raw ticks are aggregated to that
grain before any window, so a hot key is combined map-side and one key's window
partition is never longer than its calendar.
"""

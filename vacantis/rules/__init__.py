"""Rule tables: plain data, no logic.

Dictionary order is rule priority.  The compilers that turn these tables into
Catalyst expressions live in :mod:`vacantis.functions`.
"""

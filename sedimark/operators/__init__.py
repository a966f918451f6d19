"""Relational operators: index build, matching, versions, grouping, licences, reports."""
